"""Exact nearest neighbours of stated queries, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.functions.fixed import SUFFIXES

#: Bytes of query vectors sent to the workers at once. More queries go in more passes over the rows.
QUERY_BYTES = 64 << 20

NEIGHBOURS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("sim", T.DoubleType())])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(queries: DataFrame, rows: DataFrame, k: int, scope: str | None = None, apart: str = "id", query_bytes: int = QUERY_BYTES, digits: int = 6) -> DataFrame:
    """(query_id, row_id, sim): the k rows nearest to each query by cosine, ties by row_id.

    ``queries`` and ``rows`` have id, vector and, where given, the ``scope``
    within which alone they meet. A query does not find rows equal to it in the
    BIGINT column ``apart``, its own id as a rule and where that is null. What
    has a null id, vector or scope, or a vector without length, finds nothing
    and is not found. Similarities are
    rounded before ranking, so ties fall alike in any engine.

    The queries go to the workers in blocks of at most ``query_bytes``, each
    block in one pass over the rows; a task keeps its k best rows a query, and
    only those are shuffled. No pair of a query and a row is ever a record.
    """
    spark = rows.sparkSession
    own = [scope] if scope else []
    columns = [F.col("id").cast("long").alias("id"), "vector", F.coalesce(F.col(apart).cast("long"), F.col("id").cast("long")).alias("apart"), *own]
    there = " AND ".join(f"{c} IS NOT NULL" for c in ("id", "vector", *own))
    q = queries.filter(there).select(*columns)
    sizes = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).first()
    if not sizes.n:
        return spark.createDataFrame([], NEIGHBOURS)
    passes = max(1, -(-sizes.n * sizes.w * 4 // query_bytes))
    r = rows.filter(there).select(*columns)
    best = None
    for part in range(passes):
        block = q if passes == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == part)
        found = _pass(block, r, k, scope, digits)
        best = found if best is None else best.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id"))
    return best.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")


def _pass(block: DataFrame, rows: DataFrame, k: int, scope: str | None, digits: int) -> DataFrame:
    got = block.collect()  # at most query_bytes of vectors
    by_scope: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for key in {x[scope] if scope else None for x in got}:
        part = [x for x in got if not scope or x[scope] == key]
        by_scope[key] = (np.array([x.id for x in part]), np.array([x.apart for x in part]), _unit(np.array([x.vector for x in part], np.float64)))
    sent = rows.sparkSession.sparkContext.broadcast(by_scope)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            vectors = b.column(1)
            matrix = _unit(np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1))
            other = b.column(2).to_numpy(zero_copy_only=False)
            keys = np.array(b.column(3).to_pylist(), object) if scope else None
            for key, (_, own, unit) in sent.value.items():
                at = np.arange(len(ids)) if keys is None else np.flatnonzero(keys == key)
                if len(at):
                    sim = np.round(unit @ matrix[at].T, digits) + 0.0
                    sim[(own[:, None] == other[at][None, :]) | np.isnan(sim)] = -np.inf
                    top[key] = _best(top.get(key), np.broadcast_to(ids[at], sim.shape), sim, k)
        for key, (ids, sim) in top.items():
            at = np.nonzero(np.isfinite(sim))
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[key][0][at[0]]), pa.array(ids[at]), pa.array(sim[at])], names=NEIGHBOURS.names)

    return rows.mapInArrow(search, NEIGHBOURS)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def _best(before: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line, ties by id."""
    if before is not None:
        ids, sim = np.concatenate([before[0], ids], 1), np.concatenate([before[1], sim], 1)
    if sim.shape[1] > 4 * k:
        kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        keep = (sim >= kth).any(0)
        ids, sim = ids[:, keep], sim[:, keep]
    order = np.lexsort((ids, -sim), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


#: Adjustments of a candidate's score; fixed values.
POPULAR_BONUS, NO_SYNONYM, GENERIC, NO_DEFINITION, SHORT_DEFINITION, BROAD_DOMAIN = 0.025, -0.05, -0.055, -0.08, -0.04, -0.05


def fetched(k: int, language: str | None) -> int:
    """How many neighbours are looked at for k results in a language."""
    return min(max(50 * k, 100), 1000 if language == "en" else 200)


def rerank_score(sim: Column, popular: Column, definition: Column, n_terms: Column, generic: Column, broad: Column, synonyms: Column | None = None) -> Column:
    """The similarity with what speaks for and against a candidate, rounded. Without ``synonyms``, their number does not count."""
    alone = F.lit(0.0) if synonyms is None else F.when(synonyms == 0, NO_SYNONYM).otherwise(0.0)
    told = F.when(F.trim(definition) == "", NO_DEFINITION).when(generic, GENERIC).when(n_terms <= 2, SHORT_DEFINITION).otherwise(0.0)
    return F.round(sim + F.when(popular, POPULAR_BONUS).otherwise(0.0) + alone + told + F.when(broad, BROAD_DOMAIN).otherwise(0.0), 6)


def popular_half(df: DataFrame, key: str, count: str, row_id: str) -> Column:
    """Whether a row is in the upper half of its key's rows with a positive count; ties by id."""
    w = Window.partitionBy(key).orderBy(F.desc(count), row_id)
    n = F.sum(F.when(F.col(count) > 0, 1).otherwise(0)).over(Window.partitionBy(key))
    return (F.col(count) > 0) & (F.row_number().over(w) <= F.greatest(F.lit(1), F.floor((n + 1) / 2)))


def best_per_word(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_p = 1").drop("_p")


def same_stem(a: Column, b: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether two words are forms of one: equal, of one stem, or with a long shared beginning.

    The beginning of both stems is long from 5 letters and all but one of the
    shorter stem.
    """
    x, y = stem(a, suffixes), stem(b, suffixes)
    n = F.greatest(F.lit(5), F.least(F.length(x), F.length(y)) - 1)
    return (a == b) | (x == y) | ((F.least(F.length(x), F.length(y)) >= 5) & (F.left(x, n) == F.left(y, n)))


def stem(c: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The word without the first of the suffixes that it ends in, where three letters stay."""
    out = c
    for s in reversed(suffixes):
        out = F.when(F.endswith(c, F.lit(s)) & (F.length(c) > len(s) + 2), F.left(c, F.length(c) - len(s))).otherwise(out)
    return out


def family(a: Column, b: Column) -> Column:
    """Whether two words begin alike for at least 4 letters and six tenths of the shorter one."""
    short = F.least(F.length(a), F.length(b))
    n = F.greatest(F.lit(4), F.ceil(short * F.lit(0.6))).cast("int")
    return (short >= n) & (F.left(a, n) == F.left(b, n))
