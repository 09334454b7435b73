import random

from lexiweave.llm import mixing

TARGETS = "mix_name string, source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, n_tokens long, pos string"


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    chosen, plan = mixing.mix_sources(d, spark.createDataFrame(targets, TARGETS), "doc_id", "source", "n_tokens", **kw)
    return chosen, {(r.mix_name, r.source): r for r in mixing.actual_shares(chosen, plan).collect()}


def corpus(sizes, seed=1):
    r, out = random.Random(seed), []
    for s, n in sizes.items():
        out += [(len(out) + i, s, r.randint(20, 400)) for i in range(n)]
    return out


def test_shares_and_caps(spark):
    docs = corpus({"big": 4000, "mid": 900, "small": 120})
    chosen, got = mix(spark, docs, [("m", "big", 0.5, 2), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3)])
    for (_, s), r in got.items():
        assert abs(r.actual_share - r.target_share) < 0.01, s
        assert r.most_repeats <= r.max_repeats
    assert got["m", "small"].n_copies == 360  # the source that bounds the total is used up
    assert chosen.filter("repeats < 1").count() == 0


def test_positions_are_one_to_n(spark, monkeypatch):
    docs = corpus({"a": 700, "b": 3})
    sizes = spark.createDataFrame([("a", 700), ("b", 3)], "source string, source_docs long")
    monkeypatch.setattr(mixing, "PART_DOCS", 100)
    p = mixing.positions(spark.createDataFrame([(*x, "") for x in docs], DOCS).repartition(7), "doc_id", "source", "n_tokens", sizes).collect()
    assert sorted(r.pos for r in p if r.source == "a") == list(range(1, 701))
    assert sorted(r.pos for r in p if r.source == "b") == [1, 2, 3]


def test_draw_does_not_depend_on_layout(spark):
    docs = corpus({"a": 500, "b": 100})
    t = [("m", "a", 0.6, 1), ("m", "b", 0.4, 2)]
    a = sorted(mix(spark, docs, t)[0].collect())
    assert a == sorted(mix(spark, docs[::-1], t)[0].collect())
    assert a != sorted(mix(spark, docs, t, seed=5)[0].collect())


def test_nulls_empty_and_missing_sources(spark):
    docs = [(1, "a", 10), (2, None, 10), (3, "a", 0), (4, "b", None), (5, "a", 10), (5, "a", 10)]
    t = [("m", "a", 0.5, 2), ("m", "none", 0.5, 2), (None, "a", 1.0, 1), ("m", None, 0.1, 1), ("m", "a", None, 1), ("m", "b", 0.2, 0), ("z", "none", 1.0, 1), ("m", "a", 0.5, 2)]
    chosen, got = mix(spark, docs, t)
    assert sorted((r.doc_id, r.repeats) for r in chosen.collect()) == [(1, 2), (5, 2), (5, 2)]
    assert {k: (r.n_docs, r.actual_share) for k, r in got.items()} == {("m", "a"): (3, 1.0), ("m", "none"): (0, 0.0), ("z", "none"): (0, 0.0)}
    chosen, got = mix(spark, [], t)
    assert chosen.count() == 0 and all(r.n_tokens == 0 for r in got.values())
    assert mix(spark, docs, [])[0].count() == 0


def test_total_can_be_less(spark):
    docs = corpus({"a": 3000, "b": 3000})
    _, got = mix(spark, docs, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], total_tokens=100_000)
    assert abs(sum(r.n_tokens for r in got.values()) - 100_000) < 2_000


def test_scarce_sources_fall_short_of_a_given_total(spark):
    docs = corpus({"a": 2000, "b": 20})
    _, got = mix(spark, docs, [("m", "a", 0.5, 2), ("m", "b", 0.4, 3), ("m", "none", 0.1, 1)], total_tokens=200_000)
    assert abs(got["m", "a"].n_tokens - 100_000) < 500 and got["m", "a"].short_tokens == 0
    assert got["m", "b"].n_copies == 60 and abs(got["m", "b"].short_tokens + got["m", "b"].n_tokens - 80_000) < 1
    assert got["m", "none"].short_tokens == 20_000


def test_shares_of_the_test_data(spark):
    """Every source with documents has its share of the tokens of those sources."""
    from lexiweave.llm import queries

    rows = queries.p9_shares(spark, "/root/testdata/sf0.1").collect()
    whole = {}
    for r in rows:
        if r.source_docs:
            whole[r.mix_name] = whole.get(r.mix_name, 0) + r.target_share
    for r in rows:
        assert abs(r.actual_share - (r.target_share / whole[r.mix_name] if r.source_docs else 0)) < 0.01, r
        assert r.most_repeats <= r.max_repeats
