"""Checks of rows, given as rows of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.keys import trimmed


def required(c: str) -> tuple[str, Column]:
    """The column is neither null nor blank."""
    return f"{c}: missing", F.coalesce(trimmed(c), F.lit("")) == ""


def one_of(c: str, values: tuple[str, ...]) -> tuple[str, Column]:
    """The column, where filled, is one of the values."""
    return f"{c}: not allowed", F.col(c).isNotNull() & ~F.col(c).isin(*values)


def within(c: str, low: float, high: float) -> tuple[str, Column]:
    """The column, where filled, is a number within the bounds."""
    v = F.col(c).try_cast("double")
    return f"{c}: out of range", F.col(c).isNotNull() & (v.isNull() | (v < low) | (v > high) | F.isnan(v))


def violations(df: DataFrame, row_id: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """(row_id, problem): a row for each check that a row fails, in one pass."""
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda p: p.isNotNull())
    return df.select(row_id, F.explode(found).alias("problem"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): keys of more than one row."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def unresolved(df: DataFrame, row_id: str, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """(row_id, key): rows whose key, where filled, is not in the dimension."""
    d = dimension.select(F.col(dimension_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).select(row_id, key).join(d, key, "left_anti").select(row_id, key)


def check_columns(df: DataFrame, columns: list[str]) -> None:
    """Raises where columns are missing; updates may touch only listed columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def allowed_updates(updates: dict[str, object], allowed: tuple[str, ...]) -> dict[str, object]:
    """The updates, if all name allowed columns."""
    odd = sorted(set(updates) - set(allowed))
    if odd:
        raise ValueError(f"not to be updated: {', '.join(odd)}")
    return updates
