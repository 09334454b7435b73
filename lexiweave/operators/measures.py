"""Measures of rankings, scores and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.operators.ordering import places, running_totals


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, rank): each different value of a key with its average rank; ties share the mean of their ranks."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = running_totals(counts, keys, [value], F.col("n"), "_upto")
    return upto.select(*keys, value, "n", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, one column a point): quantiles between neighbouring values, exact for groups of any size; null values do not count.

    Different values are counted and their counts summed up over ranges, so no
    task holds a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running_totals(counts, keys, [value], F.col("_n"), "_upto").withColumn("_k", F.struct(F.lit(0), *keys))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("n")).withColumn("_k", F.struct(F.lit(0), *keys)).select("_k", "n")
    j = upto.join(total, "_k")
    at = lambda pos: F.max(F.when((F.col("_upto") >= pos) & (F.col("_upto") - F.col("_n") < pos), F.col(value)))
    bounds = []
    for c, q in points.items():
        h = (F.col("n") - 1) * F.lit(q)
        bounds += [at(F.floor(h) + 1).alias(f"_lo_{c}"), at(F.ceil(h) + 1).alias(f"_hi_{c}")]
    found = j.groupBy(*keys, "n").agg(*bounds)
    between = lambda c, q: F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * ((F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)))
    return found.select(*keys, "n", *[between(c, q).alias(c) for c, q in points.items()])


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the chance that a positive row scores above another, ties half; null where one kind is missing."""
    # keys in a struct are equal where both are null
    r = value_ranks(df, keys, score).select(F.struct(*keys, score).alias("_k"), "rank")
    per = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    total = per.select(*keys, F.struct(*keys, score).alias("_k"), "p", "q").join(r, "_k").groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("rank") * F.col("p")).alias("u"))
    value = (F.col("u") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return total.select(*keys, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value), 6).alias("auc"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho): rank correlation with average ranks, over rows with both values."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ra = value_ranks(rows, keys, a).select(F.struct(*keys, a).alias("_ka"), F.col("rank").alias("_a"))
    rb = value_ranks(rows, keys, b).select(F.struct(*keys, b).alias("_kb"), F.col("rank").alias("_b"))
    # rows are counted by pair of values, so the joins see each pair once; keys in a struct are equal where both are null
    pairs = rows.groupBy(*keys, a, b).agg(F.count("*").alias("n")).withColumn("_ka", F.struct(*keys, a)).withColumn("_kb", F.struct(*keys, b)).join(ra, "_ka").join(rb, "_kb")
    x, y, n = F.col("_a"), F.col("_b"), F.col("n")
    s = pairs.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    var = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
    return s.select(*keys, "n", F.round(F.when(var > 0, cov / var), 6).alias("rho"))


def ranking_measures(df: DataFrame, keys: list[str], query: str, order: list[Column], relevant: str) -> DataFrame:
    """(keys, n_queries, mrr, top1, top3): where the first relevant row of each query stands."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, query).orderBy(*order)))
    first = ranked.groupBy(*keys, query).agg(F.min(F.when(F.col(relevant), F.col("_r"))).alias("r"))
    return first.groupBy(*keys).agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("r") == 1).alias("top1"), F.count_if(F.col("r") <= 3).alias("top3")
    )


def cliff(df: DataFrame, keys: list[str], score: str, row_id: str) -> DataFrame:
    """(keys, gap, after): the largest fall between neighbours in order of score, and the place after which it comes.

    Neighbours meet by their places, so a key of any number of rows is spread
    over all tasks.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(row_id).isNotNull()).withColumn("_neg", -F.col(score))
    p = places(rows, keys, ["_neg", row_id], "_p").select(F.struct(*keys).alias("_k"), "_p", F.col(score).alias("_s"))
    after = p.select("_k", (F.col("_p") - 1).alias("_p"), F.col("_s").alias("_t"))
    gaps = p.join(after, ["_k", "_p"]).select("_k", "_p", F.round(F.col("_s") - F.col("_t"), 6).alias("gap"))
    best = F.max(F.struct("gap", (-F.col("_p")).alias("p")))
    return gaps.groupBy("_k").agg(best.alias("b")).select("_k.*", F.col("b.gap").alias("gap"), (-F.col("b.p")).alias("after"))


def stable_sample(df: DataFrame, keys: list[str], row_id: str, limit: int, seed: str = "") -> DataFrame:
    """``limit`` rows a key drawn by a hash of their ids: the same rows in any engine and layout. The limit is the operator's feature."""
    h = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(seed)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(h, row_id))
    return df.withColumn("place", place).filter(F.col("place") <= limit)


def family_heads(words: Column) -> Column:
    """The sizes of greedy families of an array of words: each word joins the first head it begins like, or becomes one.

    The result depends on the order of the array, so that is to be given. A
    word begins like a head when both share their first four letters at least
    and six tenths of the shorter one.
    """

    def alike(a: Column, b: Column) -> Column:
        short = F.least(F.length(a), F.length(b))
        n = F.greatest(F.lit(4), F.ceil(short * F.lit(0.6))).cast("int")
        return (short >= n) & (F.left(a, n) == F.left(b, n))

    start = F.array().cast("array<struct<head:string,n:int>>")

    def step(heads: Column, w: Column) -> Column:
        hit = F.transform(heads, lambda h: alike(h["head"], w))
        at = F.array_position(hit, True)
        grown = F.transform(heads, lambda h, i: F.struct(h["head"].alias("head"), F.when(i + 1 == at, h["n"] + 1).otherwise(h["n"]).alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(heads, F.array(F.struct(w.alias("head"), F.lit(1).alias("n")))))

    return F.transform(F.aggregate(words, start, step), lambda h: h["n"])
