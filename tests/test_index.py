import numpy as np
from pyspark.sql import functions as F

from lexiweave.operators import measures, vector_index, vectors


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v], "clash", 0) for i, v in enumerate(m)], "id long, vector array<float>, list string, part int")


def test_recall_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 40)  # lists are cut into parts
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    df = frame(spark, centres[r.integers(0, 30, 3000)] + 0.3 * r.normal(size=(3000, 16)))
    q = df.filter("id % 100 = 0")
    index = vector_index.build(df, 10)
    assert index.rows.count() == 3000 and index.probes < len(index.centres) / 2 and index.rows.filter("part > 0").count() > 0
    true = {(x.query_id, x.row_id) for x in vectors.nearest(q, df, 10).collect()}
    found = {(x.query_id, x.row_id): x.sim for x in vector_index.search(q, index, 10).collect()}
    assert len(true & set(found)) >= 0.9 * len(true) and len(found) == 300
    every = vector_index.search(q, index, 10, probes=len(index.centres))  # all lists give the exact search
    assert {(x.query_id, x.row_id) for x in every.collect()} == true


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (5, [1.0, 0.1])], "id long, vector array<float>")
    index = vector_index.build(df, 2)
    assert sorted(r.id for r in index.rows.collect()) == [1, 4, 5]
    got = [(r.query_id, r.row_id) for r in vector_index.search(df, index, 2).orderBy("query_id", F.desc("sim"), "row_id").collect()]
    assert got == [(1, 4), (1, 5), (4, 5), (4, 1), (5, 4), (5, 1)]
    assert vector_index.search(df, vector_index.build(df.limit(0)), 2).count() == 0


def test_quantiles(spark):
    r = np.random.default_rng(2)
    data = [("a", float(x)) for x in r.integers(0, 40, 500)] + [("b", float(x)) for x in r.normal(size=77)] + [(None, 1.0), (None, 2.0), ("c", None), ("d", 5.0)]
    got = {x.k: x for x in measures.quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99, "end": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for k, x in got.items():
        want = np.quantile([v for g, v in data if g == k], [0.05, 0.5, 0.99, 1.0])
        assert np.allclose([x.lo, x.mid, x.hi, x.end], want)
