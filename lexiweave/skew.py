"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows; fewer rows fit a task whatever the total.
HOT_ROWS = 100_000
#: At most so many keys can be hot: hot_limit() grows with the total.
MAX_HOT_KEYS = 1_000


def hot_limit(total_rows: int) -> int:
    """Rows from which a key is hot, so that at most MAX_HOT_KEYS keys are."""
    return max(HOT_ROWS, -(-total_rows // MAX_HOT_KEYS))


def hot_keys(df: DataFrame, key: str, total_rows: int) -> DataFrame:
    """The keys with at least hot_limit rows: MAX_HOT_KEYS of them at most.

    The count is combined before its shuffle, so a hot key costs one row a task.
    """
    return df.groupBy(key).count().filter(F.col("count") >= hot_limit(total_rows)).select(key)


def skew_join(many: DataFrame, unique: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """many JOIN unique ON key, where unique has one row a key.

    Rows of hot keys meet the hot part of ``unique`` by broadcast (its size is
    bounded by MAX_HOT_KEYS rows); all others shuffle, where no key is hot.
    ``how`` is inner or left.
    """
    b = F.broadcast(hot)
    few = F.broadcast(unique.join(b, key, "left_semi"))
    heavy = many.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    light = many.join(F.broadcast(hot), key, "left_anti").join(unique, key, how)
    return heavy.unionByName(light)


def salted_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, spread: str, salts: int = 32) -> DataFrame:
    """many JOIN few ON key (inner), where neither side is unique.

    Rows of ``many`` with a hot key are dealt to ``salts`` parts by a hash of
    the column ``spread``, and the rows of ``few`` with that key are copied to
    each part; other rows meet as in a plain join. Only the list of hot keys,
    MAX_HOT_KEYS at most, is broadcast.
    """
    b = F.broadcast(hot.select(key).distinct().withColumn("_hot", F.lit(True)))
    dealt = many.join(b, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = few.join(b, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
