"""Places and running totals in order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.durable import Scratch


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "total") -> DataFrame:
    """The rows with the sum of ``value`` over the rows of their key up to and with them, in ascending order of the columns ``order``.

    Rows are laid out by range of key and order, so a large group spans many
    tasks; sums run within a range, and each range of a key opens with the sums
    of those before it. The ranges are written down first, as both passes must
    see the same ones. ``order`` must tell a key's rows apart; nulls come first.
    """
    scratch = Scratch(df.sparkSession, "ordered")
    ranged = df.withColumn("_v", value).repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranges")
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    opening = sums.select(*keys, "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = ranged.withColumn("_w", F.sum("_v").over(within)).alias("a"), opening.alias("b")
    on = F.col("a._range") == F.col("b._range")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on).select("a.*", "b._o").withColumn(out, F.col("_w") + F.col("_o")).drop("_v", "_w", "_o", "_range")


def places(df: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """The rows with their place within their key, from 1, in ascending order of the columns ``order``."""
    return running_totals(df, keys, order, F.lit(1).cast("long"), out)
