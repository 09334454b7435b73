"""Trees of related words grown from roots, a level at a time for all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.operators.vectors import cosine, family
from lexiweave.skew import hot_keys, skew_join

#: Blend of a tree's scores; fixed values.
ALPHA, DECAY, FAMILY_STEP = 0.35, 0.02, 0.03


def collected(k: int) -> int:
    """How many of the best edges the penalty for families is applied to for k results."""
    return max(3 * k, k + 5)


def likened(edges: DataFrame, vectors: DataFrame, total_rows: int) -> DataFrame:
    """The edges with the cosine of both ends as score: at least 0, and 0 where a vector is missing. ``vectors`` has (node, vector)."""
    at = lambda end, v: vectors.select(F.col("node").alias(end), F.col("vector").alias(v))
    pairs = edges.select("src", "dst").distinct()
    pairs = skew_join(pairs, at("src", "_a"), "src", hot_keys(pairs, "src", total_rows))
    pairs = skew_join(pairs, at("dst", "_b"), "dst", hot_keys(pairs, "dst", total_rows))
    sims = pairs.select("src", "dst", F.round(F.greatest(F.lit(0.0), F.coalesce(cosine(F.col("_a"), F.col("_b")), F.lit(0.0))), 6).alias("_sim"))
    return edges.join(sims, ["src", "dst"], "left").withColumn("score", F.coalesce("_sim", F.lit(0.0))).drop("_sim")


def children(edges: DataFrame, k: int, step: float = FAMILY_STEP, near: DataFrame | None = None) -> DataFrame:
    """(src, dst, score, place): the k best targets of every source.

    ``edges`` has src, dst, tier (0 best), score and seq. A target counts with
    its best tier. All targets are ranked by score, equal ones by tier and
    seq; of the first ``collected(k)`` each loses ``step`` for every better one
    of its family. A source's edges are cut to that number before anything
    joins them, so a source of any degree is a few rows from there on.

    ``near`` has (src, dst, sim), what lies near a source by its vector. Where a
    source has fewer than ``collected(k)`` targets, or no edge, the nearest that
    are none of its targets fill the rest, with sim as score.
    """
    once = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("tier", "seq", (-F.col("score")).alias("neg"))).alias("e"))
    ranked = once.withColumn("score", F.round(-F.col("e.neg"), 6))
    first = Window.partitionBy("src").orderBy(F.desc("score"), "e.tier", "e.seq", "dst")
    kept = ranked.withColumn("_p", F.row_number().over(first)).filter(F.col("_p") <= collected(k)).select("src", "dst", "score")
    if near is not None:
        have = kept.groupBy("src").agg(F.count("*").alias("_n"))
        more = near.filter("src <> dst").join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
        more = more.withColumn("_p", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))).filter(F.col("_p") <= collected(k))
        more = more.join(have, "src", "left").filter(F.col("_p") <= collected(k) - F.coalesce("_n", F.lit(0)))
        kept = kept.unionByName(more.select("src", "dst", F.round("sim", 6).alias("score")))
    a, b = kept.alias("a"), kept.alias("b")
    better = F.expr("a.src = b.src AND (b.score > a.score OR (b.score = a.score AND b.dst < a.dst))") & family(F.col("a.dst"), F.col("b.dst"))
    n = a.join(b, better).groupBy(F.col("a.src").alias("src"), F.col("a.dst").alias("dst")).agg(F.count("*").alias("n"))
    scored = kept.join(n, ["src", "dst"], "left").withColumn("score", F.round(F.col("score") - step * F.coalesce("n", F.lit(0)), 6))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("src", "dst", "score", "place")


def grow(roots: DataFrame, kids: DataFrame, deep_kids: DataFrame, origin: DataFrame, depth: int, alpha: float = ALPHA, decay: float = DECAY) -> DataFrame:
    """(root, depth, node, parent, score, lineage): the tree of every root, root included.

    ``kids`` and ``deep_kids`` are as of children(), for the first level and
    those below. ``origin`` has (root, node, sim), the likeness to the root;
    missing ones count 0. A node's score is (1 - alpha) * edge + alpha * origin
    - decay * depth, at least 0. Within a level a node keeps its best parent,
    and a node belongs to the first level it occurs in. The loop has ``depth``
    rounds, each one join over all roots, written down to cut its lineage.
    """
    scratch = Scratch(roots.sparkSession, "trees")
    level = roots.select(F.col("node").alias("root"), F.lit(0).alias("depth"), "node", F.lit(None).cast("string").alias("parent"), F.lit(1.0).alias("score"), F.array().cast("array<int>").alias("lineage")).distinct()
    level = scratch.write(level, "level0")
    tree = level
    for n in range(1, depth + 1):
        step = (kids if n == 1 else deep_kids).select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.col("score").alias("edge"), "place")
        grown = level.select("root", F.col("node").alias("parent"), F.col("lineage").alias("above")).join(step, "parent")
        known = origin.select("root", F.col("node").alias("child"), "sim")
        score = F.round(F.greatest(F.lit(0.0), (1 - alpha) * F.col("edge") + alpha * F.coalesce("sim", F.lit(0.0)) - decay * n), 6)
        scored = grown.join(known, ["root", "child"], "left").withColumn("score", score)
        new = scored.join(tree.select("root", F.col("node").alias("child")), ["root", "child"], "left_anti")
        best = F.row_number().over(Window.partitionBy("root", "child").orderBy(F.desc("score"), "above", "place"))
        new = new.withColumn("_b", best).filter("_b = 1")
        sibling = F.row_number().over(Window.partitionBy("root", "parent").orderBy(F.desc("score"), "child"))
        new = new.withColumn("_s", sibling)
        level = new.select("root", F.lit(n).alias("depth"), F.col("child").alias("node"), "parent", "score", F.concat("above", F.array("_s")).alias("lineage"))
        level = scratch.write(level, f"level{n}")
        tree = tree.unionByName(level)
        if level.isEmpty():
            break
    return tree
