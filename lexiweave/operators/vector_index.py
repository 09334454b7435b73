"""An inverted index of vectors: nearest neighbours among the rows of the lists nearest to a query.

The lists' centres are fitted on a bounded sample; every row is put into the
list of its nearest centre. How many lists a query looks into is set by the
recall that the sample shows. vectors.nearest is the exact search beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.durable import Scratch
from lexiweave.operators.vectors import NEIGHBOURS, _best, _unit

#: Rows that the centres are fitted on, bytes of their vectors at most, lists at most, and sample rows that stand as queries to measure recall.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LISTS, SAMPLE_QUERIES = 20_000, 64 << 20, 1_024, 256
#: The recall that the sample must show, somewhat above what is wanted of all rows.
TARGET_RECALL = 0.97
#: Rows of a list's part, which meet their queries in one task.
PART_ROWS = 50_000


@dataclass(frozen=True)
class Index:
    """Centres of unit length, the lists a query looks into, and the rows as (list, part, id, vector)."""

    centres: np.ndarray
    probes: int
    rows: DataFrame


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit length, from evenly spaced rows on."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The fewest lists in which the sample's own nearest neighbours are found as often as the target says."""
    queries = sample[: SAMPLE_QUERIES]
    sim = queries @ sample.T
    np.fill_diagonal(sim[:, : len(queries)], -np.inf)
    true = np.argsort(-sim, 1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(np.argsort(-(queries @ centres.T), 1), 1)  # at each list, when a query comes to it
    when = np.take_along_axis(order, (sample @ centres.T).argmax(1)[true], 1)
    found = [(when < p).mean() for p in range(1, len(centres) + 1)] if true.size else [1.0]
    return int(np.argmax(np.array(found) >= target)) + 1


def build(rows: DataFrame, k: int = 10, target: float = TARGET_RECALL) -> Index:
    """The index of all rows (id, vector) with an id and a vector that has a length; others are in no list.

    The sample is drawn by a hash of the id: SAMPLE_ROWS rows, or as many as
    SAMPLE_BYTES hold. No rows give an index without centres.
    """
    r = rows.filter("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    r = r.filter(F.exists("vector", lambda x: x != 0))
    size = r.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).first()
    if not size.n:
        return Index(np.empty((0, 0)), 1, r.select(F.lit(0).alias("list"), F.lit(0).alias("part"), "id", "vector"))
    drawn = r.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * size.w))).select("vector").collect()
    sample = _unit(np.array([x.vector for x in drawn], np.float64))
    centres = _centres(sample, max(1, min(MAX_LISTS, int(size.n**0.5), len(sample) // 16)))
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _unit(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array((m @ sent.value.T).argmax(1).astype(np.int32)), b.column(0), b.column(1)], names=["list", "id", "vector"])

    listed = r.mapInArrow(assign, "list int, id long, vector array<float>")
    listed = Scratch(rows.sparkSession, "index").write(listed, "listed")
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # MAX_LISTS rows
    listed = listed.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector")
    return Index(centres, _probes(sample, centres, k, target), listed)


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, row_id, sim): up to k rows near each query by cosine, ties by row_id, the query's own id left out.

    Queries are copied to the lists that they look into, and meet each part of
    them in one task, which keeps k rows a query.
    """
    spark = index.rows.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], NEIGHBOURS)
    q = queries.filter("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    sent, n = spark.sparkContext.broadcast(index.centres), min(probes or index.probes, len(index.centres))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.nan_to_num(_unit(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)))
                near = np.argsort(-(m @ sent.value.T), 1)[:, :n].astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column(0).take(at), b.column(1).take(at)], names=["list", "id", "vector"])

    asked = q.mapInArrow(lists, "list int, id long, vector array<float>")
    parts = F.broadcast(index.rows.select("list", "part").distinct())  # at most MAX_LISTS and one for each PART_ROWS rows
    asked = asked.join(parts, "list").toDF("list", "id", "vector", "part").select("list", "part", "id", "vector")

    nothing = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=NEIGHBOURS.names)

    def meet(own: pa.Table, rows: pa.Table) -> pa.Table:
        if not own.num_rows or not rows.num_rows:
            return nothing
        unit = [_unit(np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)) for t in (own, rows)]
        ids, qid = rows["id"].to_numpy(), own["id"].to_numpy()
        sim = np.round(unit[0] @ unit[1].T, digits) + 0.0
        sim[(qid[:, None] == ids[None, :]) | np.isnan(sim)] = -np.inf
        ids, sim = _best(None, np.broadcast_to(ids, sim.shape), sim, k)
        at = np.nonzero(np.isfinite(sim))
        return pa.table([pa.array(qid[at[0]]), pa.array(ids[at]), pa.array(sim[at])], names=NEIGHBOURS.names)

    held = index.rows.toDF("list", "part", "id", "vector")
    found = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInArrow(meet, T.StructType(NEIGHBOURS.fields))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "row_id"))
    return found.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")
