"""Consolidating pairwise matches into groups by random contraction.

In each round every vertex hooks to the member of its closed neighbourhood
that comes first in a fresh hash order; edges are relabelled and made
distinct, which leaves about half of the vertices. When no edge is left, the
rounds' mappings are expanded backwards, and each group is named.

Vertices are 64-bit hashes of their texts, kept apart where two texts share
one. A round's order is a one-to-one mixing of these numbers, so the least
mixed number of a neighbourhood tells its vertex, and every round is integer
aggregation and integer joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.skew import MAX_HOT_KEYS, hot_keys, hot_limit, skew_join

#: Rounds after which something is wrong: half of the vertices go in each.
MAX_ROUNDS = 200


def _relabelled(edges: DataFrame, end: str, mapping: DataFrame) -> DataFrame:
    """The edges with one end replaced by its representative; unmapped ends stay."""
    hot = F.broadcast(mapping.filter("hot").select(F.col("v").alias(end), "rep"))
    cold = mapping.filter("NOT hot").select(F.col("v").alias(end), "rep")
    heavy = edges.join(hot, end)
    light = edges.join(F.broadcast(hot.select(end)), end, "left_anti").join(cold, end, "left")
    other = "b" if end == "a" else "a"
    return heavy.unionByName(light).select(F.coalesce("rep", end).alias(end), other)


def _distinct(edges: DataFrame) -> DataFrame:
    """Each pair of different ends once, smaller end first."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Steps of the mixing, each of which hashes one half of a number into the other.
STEPS = 3
_HALF = (1 << 32) - 1


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _mixed(c: Column, k: int) -> Column:
    """A number in the order of round k: its halves are hashed into one another, which is one to one."""
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_HALF))
    for j in range(STEPS):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(k * STEPS + j)).bitwiseAND(F.lit(_HALF)))
    return _joined(high, low)


def _unmixed(c: Column, k: int) -> Column:
    """The number of which _mixed made ``c``."""
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_HALF))
    for j in reversed(range(STEPS)):
        high, low = low.bitwiseXOR(F.xxhash64(high, F.lit(k * STEPS + j)).bitwiseAND(F.lit(_HALF))), high
    return _joined(high, low)


def vertex_hash(name: Column) -> Column:
    """The number of a name."""
    return F.xxhash64(name)


def number_vertices(names: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vertices, apart): (name, id) with one id a name, and those of them whose id is not their plain hash.

    Of names that share a hash all but the first get another one, until none
    is shared; among ten billion names about three pairs share one.
    """
    plain = vertex_hash(F.col("name"))
    vertices = scratch.write(names.select("name", plain.alias("id")), "vertices0")
    for k in range(1, MAX_ROUNDS):
        shared = vertices.groupBy("id").agg(F.count("*").alias("n"), F.min("name").alias("first")).filter("n > 1")
        n = shared.count()
        if not n:
            return vertices, vertices.filter(F.col("id") != plain)
        if n > MAX_HOT_KEYS:
            raise RuntimeError(f"{n} ids are shared; the hash of names does not tell them apart")
        again = vertices.join(F.broadcast(shared.select("id", "first")), "id", "left")
        moved = F.when(F.col("first").isNotNull() & (F.col("name") != F.col("first")), F.xxhash64(F.lit(k), "name")).otherwise(F.col("id"))
        vertices = scratch.write(again.select("name", moved.alias("id")), f"vertices{k}")
        scratch.drop(f"vertices{k - 1}")
    raise RuntimeError("ids stay shared")


def contract(pairs: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(name, label): a label for each vertex, equal within a component.

    ``pairs`` may hold null ends (left out), self pairs, and repeats or turned
    pairs in any number. A vertex of any degree is one row a task in the
    hooking, and its relabelling goes by broadcast.
    """
    named = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    first = scratch.write(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    vertices, apart = number_vertices(first.select(F.explode(F.array("a", "b")).alias("name")).distinct(), scratch)
    edges = first.filter("a <> b")
    moved = apart.count()  # of the MAX_HOT_KEYS names that number_vertices allows in each of its rounds
    for end in ("a", "b"):
        plain = vertex_hash(F.col(end))
        if moved:
            edges = edges.join(F.broadcast(apart.select(F.col("name").alias(end), "id")), end, "left").withColumn(f"_{end}", F.coalesce("id", plain)).drop("id")
        else:
            edges = edges.withColumn(f"_{end}", plain)
    edges = scratch.write(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "edges")
    n, rounds = edges.count(), []
    while n:
        k = len(rounds)
        if k >= MAX_ROUNDS:
            raise RuntimeError(f"{n} edges left after {k} rounds")
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        best = both.select("v", _mixed(F.col("w"), k).alias("m")).groupBy("v").agg(F.min("m").alias("m"), F.count("*").alias("degree"))
        rep = _unmixed(F.least(F.col("m"), _mixed(F.col("v"), k)), k)
        mapping = best.select("v", rep.alias("rep"), (F.col("degree") >= hot_limit(2 * n)).alias("hot"))
        mapping = scratch.write(mapping.filter("v <> rep OR hot"), f"map{k}")
        rounds.append(mapping)
        shrunk = _relabelled(_relabelled(edges, "a", mapping), "b", mapping)
        edges = scratch.write(_distinct(shrunk), f"edges{k}")
        n = edges.count()
        scratch.drop("edges", f"edges{k - 1}")
    labels = None
    for k, mapping in reversed(list(enumerate(rounds))):
        step = mapping.select("v", F.col("rep").alias("r"))
        if labels is not None:
            ends = labels.select(F.col("v").alias("r"), "label")
            moved_on = skew_join(step, ends, "r", hot_keys(step, "r", step.count()), "left").select("v", F.coalesce("label", "r").alias("label"))
            step = moved_on.unionByName(labels.join(mapping.select("v"), "v", "left_anti"))
        else:
            step = step.withColumnRenamed("r", "label")
        labels = scratch.write(step, f"labels{k}")
        scratch.drop(f"labels{k + 1}", f"map{k}")
    if labels is None:
        return vertices.select("name", F.col("id").alias("label"))
    return vertices.join(labels.withColumnRenamed("v", "id"), "id", "left").select("name", F.coalesce("label", "id").alias("label"))


def group_pairs(pairs: DataFrame, a: str, b: str, member: str = "member", group: str = "group_id") -> DataFrame:
    """(member, group): each text that any pair names, with the first member of its group in byte order.

    A chain of any length is one group. A self pair makes a group of one; no
    pairs give no rows. Other columns of ``pairs`` are not read.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    labels = scratch.write(contract(pairs, a, b, scratch), "labels")
    names = labels.groupBy("label").agg(F.min("name").alias("first"))
    out = skew_join(labels, names, "label", hot_keys(labels, "label", labels.count()))
    return out.select(F.col("name").alias(member), F.col("first").alias(group))
