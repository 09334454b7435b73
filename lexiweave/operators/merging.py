"""Merging batches into tables, comparing tables, and keeping the best of repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.skew import hot_keys, skew_join

#: Order of states and certainties in which a repeat is kept; fixed values.
STATUS_ORDER = ("reviewed", "unreviewed", "rejected")
CONFIDENCE_ORDER = ("high", "medium", "low")


def _prefixed(df: DataFrame, key: list[str], columns: list[str], mark: str) -> DataFrame:
    return df.select(*key, F.struct(*columns).alias(mark))


def _joined(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], how: str) -> DataFrame:
    """Both sides as structs o and n under the key; null keys match null keys."""
    a, b = _prefixed(old, key, columns, "o").alias("a"), _prefixed(new, key, columns, "n").alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    return a.join(b, on, how).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], "o", "n")


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows and those new ones whose key is not there: an incumbent stays. Repeats within the new rows stay one, the least."""
    columns = [c for c in old.columns if c not in key]
    fresh = new.groupBy(*key).agg(F.min(F.struct(*columns)).alias("n"))
    a, b = fresh.alias("a"), old.select(*key).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    added = a.join(b, on, "left_anti").select(*key, *[F.col("n")[c].alias(c) for c in columns])
    return old.unionByName(added.select(*old.columns))


def fill_missing(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The old rows with nulls in ``columns`` filled from the new ones, and new rows of keys not there. Both have one row a key."""
    j = _joined(old, new, key, columns, "full")
    return j.select(*key, *[F.coalesce(F.col("o")[c], F.col("n")[c]).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: of new rows the first by ``order``, where there is none the old one."""
    columns = [c for c in old.columns if c not in key]
    best = new.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_p = 1").select(*old.columns)
    j = _joined(old, best, key, columns, "full")
    return j.select(*key, *[F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col("o")[c]).alias(c) for c in columns])


def differences(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, outcome): added, removed, changed or same; nulls are equal to nulls. Both have one row a key."""
    j = _joined(old, new, key, columns, "full")
    outcome = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "same").otherwise("changed")
    return j.select(*key, outcome.alias("outcome"))


def merge_counts(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(outcome, n): what a merge would do, without doing it."""
    return differences(old, new, key, columns).groupBy("outcome").agg(F.count("*").alias("n"))


def in_order(c: Column, values: tuple[str, ...]) -> Column:
    """The place of a value among the listed ones; others and null come last."""
    return F.coalesce(*[F.when(c == v, i) for i, v in enumerate(values)], F.lit(len(values)))


def keep_best(df: DataFrame, key: list[str], row_id: str, order: list[Column] | None = None) -> DataFrame:
    """(key, row_id, n_rows): the row to keep of each key, by state, certainty and id; found by a minimum, so no key's rows are sorted."""
    order = order or [in_order(F.col("review_status"), STATUS_ORDER), in_order(F.col("confidence"), CONFIDENCE_ORDER)]
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("id")))
    return df.groupBy(*key).agg(best.alias("b"), F.count("*").alias("n_rows")).select(*key, F.col("b.id").alias(row_id), "n_rows")


def rekeyed(rows: DataFrame, group: list[str], old_key: str, new_key: str, row_id: str, total_rows: int) -> DataFrame:
    """(row_id, action): what a new key makes of each row: same, update, or collapse into another row of that key.

    A row that already has the key stays; else the lowest id takes it. The one
    to stay is found by a minimum, and rows of hot keys meet it by broadcast.
    """
    k = rows.select(F.struct(*group, new_key).alias("k"), F.coalesce(F.col(old_key) != F.col(new_key), F.lit(True)).alias("changed"), F.col(old_key).eqNullSafe(F.col(new_key)).alias("same"), F.col(row_id).alias("i"))
    stays = k.groupBy("k").agg(F.min(F.struct("changed", "i")).alias("b")).select("k", F.col("b.i").alias("stays"))
    j = skew_join(k, stays, "k", hot_keys(k, "k", total_rows))
    action = F.when(F.col("i") != F.col("stays"), "collapse").when(F.col("same"), "same").otherwise("update")
    return j.select(F.col("i").alias(row_id), action.alias("action"))


def append_unseen(base: DataFrame, candidates: DataFrame, key: list[str], accepted: Column) -> DataFrame:
    """The base catalogue and the accepted candidates of keys it lacks, the least of repeats."""
    return insert_missing(base, candidates.filter(accepted).select(*base.columns), key)


def cascade(parents: DataFrame, children: DataFrame, parent_id: str, foreign: str, set_null: bool = False) -> DataFrame:
    """The children after their parents are cut to ``parents``: those without one are dropped, or lose their link.

    A null link has no parent to lose and stays.
    """
    there = parents.select(F.col(parent_id).alias("_p")).distinct().withColumn("_there", F.lit(True))
    j = children.join(there, F.col(foreign) == F.col("_p"), "left")
    if set_null:
        return j.withColumn(foreign, F.when(F.col("_there"), F.col(foreign))).drop("_p", "_there")
    return j.filter(F.col("_there") | F.col(foreign).isNull()).drop("_p", "_there")
