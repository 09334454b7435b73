"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected in the mix the same number of times.
The expected copies are summed up along the source, one random offset is
added, and a document is emitted once for each integer its share crosses. The
documents lie in order of size, so a sample's tokens change little from one
offset to the next, and of some offsets, spread evenly from a random first
one, that is taken whose tokens come nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.durable import Scratch

#: Rows a table of targets may have: it is a control table and is broadcast.
MAX_TARGETS = 10_000
#: Documents of a part of a source on average, which one task numbers.
PART_DOCS = 1 << 20
#: Offsets that are compared.
OFFSETS = 32


def clean_targets(targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats): the rows that say something, one for each source of a mix.

    Targets with a null name, source or share, a share of 0 or less, or no
    repeats are left out; a target listed twice counts with its first row in
    order of share and repeats.
    """
    if targets.count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    t = targets.select("mix_name", "source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).filter("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    return t.groupBy("mix_name", "source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("mix_name", "source", "t.*")


def plan_mixes(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_docs, source_tokens, target_tokens, rate): the copies expected of a document.

    Without ``total_tokens`` a mix is as large as it can be with every share
    met: as its scarcest source allows that has tokens. With ``total_tokens``
    that size holds, and scarce sources stop at their repeats and fall short.
    A source without tokens has a null rate and falls short of all its target.
    """
    j = targets.join(sizes, "source", "left")
    most = F.min(F.when(F.col("source_tokens") > 0, F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))).over(Window.partitionBy("mix_name"))
    total = F.coalesce(most, F.lit(0.0)) if total_tokens is None else F.lit(float(total_tokens))
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("target_share") * total / F.col("source_tokens"), F.col("max_repeats").cast("double")))
    return j.select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("source_docs", F.lit(0)).alias("source_docs"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        (F.col("target_share") * total).alias("target_tokens"), rate.alias("rate"),
    )


def positions(docs: DataFrame, doc_id: str, source: str, size: str, sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size, pos): each document's place in its source, from 1, in order of size, by eighths of its binary logarithm.

    The prefix sum has two levels: rows are counted by part of the source, the
    parts' counts are summed up, and a row's place is counted within its part.
    A source has as many parts as keep one at PART_DOCS; ``sizes`` has its
    (source, source_docs) and at most MAX_TARGETS rows.
    """
    parts = F.broadcast(sizes.select(F.col("source"), F.ceil(F.col("source_docs") / PART_DOCS).cast("int").alias("parts")))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size")).join(parts, "source")
    step = F.floor(F.log2(F.col("size")) * 8).cast("long") * F.col("parts") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    d = d.select("doc_id", "source", "size", step.alias("part"))
    counts = d.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opening = counts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("opening"))
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("size", F.xxhash64("doc_id"), "doc_id"))
    return d.join(opening, ["source", "part"]).select("doc_id", "source", "size", (F.col("opening") + within).alias("pos"))


def _copies(pos: Column, rate: Column, offset: Column) -> Column:
    """The integers that a document's share of the expected copies crosses."""
    return F.floor(rate * pos + offset) - F.floor(rate * (pos - 1) + offset)


def with_offsets(plan: DataFrame, placed: DataFrame, seed: int) -> DataFrame:
    """The plan with the ``offset`` of each source, a number from 0 to 1 in steps of a millionth.

    All documents are read once, and each task sums what every offset would
    draw of them.
    """
    first = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(10**6))
    offsets = [(F.pmod(first + 10**6 * j // OFFSETS, F.lit(10**6)) / 10**6) for j in range(OFFSETS)]
    rates = F.broadcast(plan.filter("rate > 0").select("mix_name", "source", "rate", "target_tokens", *[o.alias(f"o{j}") for j, o in enumerate(offsets)]))
    drawn = [F.sum(F.col("size") * _copies(F.col("pos"), F.col("rate"), F.col(f"o{j}"))).alias(f"s{j}") for j in range(OFFSETS)]
    sums = placed.join(rates, "source").groupBy("mix_name", "source", "target_tokens", *[f"o{j}" for j in range(OFFSETS)]).agg(*drawn)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{j}") - F.col("target_tokens")).alias("off"), F.lit(j).alias("j"), F.col(f"o{j}").alias("offset")) for j in range(OFFSETS)]))
    return plan.join(sums.select("mix_name", "source", best["offset"].alias("offset")), ["mix_name", "source"], "left")


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, size: str, seed: int = 0, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): chosen has (mix_name, doc_id, source, n_tokens, repeats) with repeats of 1 to max_repeats.

    Documents without source or tokens are never drawn. The draw depends on the
    seed and the rows alone, not on how they are laid out. A repeated doc_id
    counts as another document. Expected copies are decimals, so sums over any
    number of documents stay exact.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    targets = scratch.write(clean_targets(targets), "targets")
    listed = F.broadcast(targets.select(F.col("source").alias(source)).distinct())
    d = docs.filter(F.col(source).isNotNull() & (F.col(size) > 0)).join(listed, source, "left_semi")
    sizes = scratch.write(d.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("source_docs"), F.sum(size).alias("source_tokens")), "sizes")
    placed = scratch.write(positions(d, doc_id, source, size, sizes), "placed")
    plan = scratch.write(with_offsets(plan_mixes(sizes, targets, total_tokens), placed, seed), "plan")
    rates = F.broadcast(plan.filter("rate > 0").select("mix_name", "source", F.col("rate").cast("decimal(24,18)").alias("rate"), F.col("offset").cast("decimal(18,18)").alias("offset")))
    copies = _copies(F.col("pos").cast("decimal(12,0)"), F.col("rate"), F.col("offset")).cast("int")
    chosen = placed.join(rates, "source").select("mix_name", "doc_id", "source", F.col("size").alias("n_tokens"), copies.alias("repeats")).filter("repeats > 0")
    return chosen, plan


def actual_shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, n_docs, n_copies, n_tokens, short_tokens, most_repeats, max_repeats, source_docs) a source of each mix.

    ``short_tokens`` is what a source lacks that its repeats or its want of
    documents keep from its target.
    """
    used = chosen.groupBy("mix_name", "source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("repeats").cast("long")).alias("n_copies"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    j = plan.join(used, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_copies", "n_tokens", "most_repeats"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    share = F.when(whole > 0, F.col("n_tokens") / whole).otherwise(F.lit(0.0))
    bound = F.col("rate").isNull() | (F.col("rate") >= F.col("max_repeats"))
    short = F.when(bound, F.greatest(F.col("target_tokens") - F.col("n_tokens"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("short_tokens")
    return j.select("mix_name", "source", "target_share", share.alias("actual_share"), "n_docs", "n_copies", "n_tokens", short, "most_repeats", "max_repeats", "source_docs")
