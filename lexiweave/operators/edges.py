"""Building and resolving links between words, senses and concepts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.skew import hot_keys, salted_join, skew_join

#: Part of a sense's largest routing weight from which a target counts too; fixed value.
KEEP_RATIO = 0.6
#: Tokens of left rows sent to the workers at once. More go in more passes over the right rows.
BLOCK_TOKENS = 500_000


def first_row(df: DataFrame, keys: list[str], order: list[Column], *columns: str) -> DataFrame:
    """The columns of each key's first row by the order, by a minimum that is combined before its shuffle."""
    best = F.min(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *[F.col(c) for c in columns]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in columns])


def primary_senses(senses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sense_id): the sense of lowest index, the lowest id among ties; a null index comes last."""
    return first_row(senses, keys, [F.coalesce("sense_index", F.lit(2**31 - 1))], "sense_id")


def shared_keys(queries: DataFrame, rows: DataFrame, word: str, key: str, total_rows: int) -> DataFrame:
    """(word, other, n_shared): how many different keys each stated query word shares with each other word.

    Repeats are made one before they meet, and hot keys are dealt to several tasks.
    """
    q = queries.select(word, key).filter(F.col(key).isNotNull()).distinct()
    r = rows.select(F.col(word).alias("other"), key).filter(F.col(key).isNotNull()).distinct()
    j = salted_join(r, q, key, hot_keys(r, key, total_rows), "other").filter(F.col("other") != F.col(word))
    return j.groupBy(word, "other").agg(F.count("*").alias("n_shared"))


def comembers(members: DataFrame, group: str, member: str, total_rows: int) -> DataFrame:
    """(group, hub, member): each member of a group beside the group's first, in order of text.

    A group's members are all linked to one another through its hub: two
    members of a group are co-members. So a group of n gives n - 1 rows, not
    one for each pair, whatever its size.
    """
    m = members.select(group, member).filter(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    hubs = m.groupBy(group).agg(F.min(member).alias("hub"))
    return skew_join(m, hubs, group, hot_keys(m, group, total_rows)).filter(F.col(member) != F.col("hub")).select(group, "hub", member)


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, once; self edges and edges with a null end left out."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def routed(weights: Column) -> tuple[Column, Column]:
    """(first position of the largest weight, positions of at least KEEP_RATIO of it), from 1; null and empty for no weights."""
    top = F.array_max(weights)
    kept = F.filter(F.transform(weights, lambda w, i: F.when(w >= top * KEEP_RATIO, i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(weights) > 0, F.array_position(weights, top)).cast("int"), kept


def resolve(rows: DataFrame, key: str, targets: list[tuple[str, DataFrame]], total_rows: int) -> DataFrame:
    """The rows with target_id and found_in: the first of the named target tables (key, target_id) that has the key.

    Each target is made unique by its lowest id. Rows that none has get null
    and 'unresolved'; a null key is unresolved.
    """
    hot = hot_keys(rows, key, total_rows)
    out, names = rows, []
    for name, t in targets:
        one = t.groupBy(key).agg(F.min("target_id").alias(f"_t_{name}"))
        out = skew_join(out.filter(F.col(key).isNotNull()), one, key, hot, "left").unionByName(out.filter(F.col(key).isNull()), allowMissingColumns=True)
        names.append(name)
    found = F.coalesce(*[F.when(F.col(f"_t_{n}").isNotNull(), n) for n in names], F.lit("unresolved"))
    return out.withColumn("target_id", F.coalesce(*[F.col(f"_t_{n}") for n in names])).withColumn("found_in", found).drop(*[f"_t_{n}" for n in names])


def priority_union(sources: list[DataFrame], keys: list[str], value: str, limit: int) -> DataFrame:
    """(keys, value, priority): the first ``limit`` different values a key from several sources in order of priority, first source wins."""
    both = None
    for i, s in enumerate(sources):
        part = s.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("priority", F.lit(i))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy(*keys, value).agg(F.min("priority").alias("priority"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", value))
    return once.withColumn("place", place).filter(F.col("place") <= limit)


def best_overlap(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, tokens: str, right_tokens: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """(left_id, right_id, n_shared): for each left row the right row of the same key that shares most tokens, the lower id among ties.

    Ids are unique BIGINTs; tokens count once a row, and null ids, keys and
    tokens not at all. Left rows without a common token have no row.

    The left rows go to the workers as lists of rows by token, in blocks of
    about ``block`` tokens, each block in one pass over the right rows. A task
    counts what each right row shares with the block and keeps the best of
    every left row, and only those are shuffled: no pair is ever a record.
    """
    columns = lambda df, i, t: df.select(F.col(key).alias("key"), F.col(i).cast("long").alias("id"), F.array_compact(F.array_distinct(t)).alias("t")).filter("key IS NOT NULL AND id IS NOT NULL AND size(t) > 0")
    lft, r = columns(left, left_id, tokens), columns(right, right_id, right_tokens)
    shape = T.StructType([T.StructField(left_id, T.LongType()), T.StructField(right_id, T.LongType()), T.StructField("n_shared", T.LongType())])
    total = lft.agg(F.sum(F.size("t")).alias("n")).first().n
    if not total:
        return left.sparkSession.createDataFrame([], shape)
    passes = -(-total // block)
    best = None
    for part in range(passes):
        found = _overlaps(lft.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == part), r, shape)
        best = found if best is None else best.unionByName(found)
    return first_row(best, [left_id], [-F.col("n_shared"), F.col(right_id)], right_id, "n_shared")


def _overlaps(block: DataFrame, right: DataFrame, shape: T.StructType) -> DataFrame:
    """The best of the right rows that each task sees, for every left row of the block."""
    ids: dict[object, list[int]] = {}
    lists: dict[object, dict[str, list[int]]] = {}
    for x in block.collect():  # about BLOCK_TOKENS tokens
        own, by_token = ids.setdefault(x.key, []), lists.setdefault(x.key, {})
        for t in x.t:
            by_token.setdefault(t, []).append(len(own))
        own.append(x.id)
    index = {k: (np.array(own), {t: np.array(at, np.int32) for t, at in lists[k].items()}) for k, own in ids.items()}
    sent = right.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for key, i, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in sent.value:
                    continue
                own, by_token = sent.value[key]
                at = [by_token[t] for t in words if t in by_token]
                if not at:
                    continue
                n, row = top.setdefault(key, (np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)))
                shared = np.bincount(np.concatenate(at), minlength=len(own))
                better = (shared > n) | ((shared == n) & (shared > 0) & (i < row))
                n[better], row[better] = shared[better], i
        for key, (n, row) in top.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[key][0][at]), pa.array(row[at]), pa.array(n[at])], names=shape.names)

    return right.mapInArrow(search, shape)
