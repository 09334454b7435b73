"""Writers with a fixed order of columns, and replacement of whole parts of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexiweave.operators.validation import check_columns


def write_text(df: DataFrame, path: str, columns: list[str], form: str = "csv", replace: bool = False, files: int | None = None) -> None:
    """Writes the columns in their order as csv, json or parquet. What is there is an error unless it is to be replaced.

    ``files`` sets the number of files for small exports; by default every
    task writes its own.
    """
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"no such form: {form}")
    check_columns(df, columns)
    out = df.select(*columns)
    w = (out.coalesce(files) if files else out).write.mode("overwrite" if replace else "errorifexists")
    if form == "csv":
        w = w.options(header=True, escape='"', emptyValue="", nullValue="")
    w.format(form).save(path)


def replace_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the rows, replacing only the parts of the table whose values of ``by`` occur among them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
