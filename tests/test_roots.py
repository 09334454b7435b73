from pyspark.sql import functions as F

from lexiweave.operators import roots

V = {"a": [1.0, 0.0], "near": [0.99, 0.14], "mid": [0.9, 0.44], "far": [0.0, 1.0]}
FLOORS = {"rescue": {"xx": 0.8}, "fallback": {"xx": 0.95, "yy": 0.999}}
SENSE = "sense_id long, lexeme_id long, language string, sense_index int, lemma string, definition string, vector array<double>"


def ladder(spark, senses, links=(), mine=(), ilis=(), proposed=None, anchor="a"):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = roots.select_roots(
        df([(1, "word", V.get(anchor))], "anchor_id long, lemma string, vector array<double>"), df([(1, x) for x in mine], "anchor_id long, ili string"), df([(1, *x) for x in links], "anchor_id long, lexeme_id long, original boolean"),
        df([(i, x, g, n, w, t, V.get(v)) for i, x, g, n, w, t, v in senses], SENSE), df(ilis, "sense_id long, ili string"), df([("xx", 1), ("yy", 2)], "language string, number int"),
        None if proposed is None else df([(1, x) for x in proposed], "anchor_id long, lexeme_id long"), FLOORS,
    )
    return {r.language: (r.rung, r.sense_id) for r in out.collect()}


A, B, C = (10, 100, "xx", 0, "ab", "thing", "mid"), (20, 200, "xx", 0, "a", "other", "near"), (30, 300, "xx", 0, "c", "the word itself", "near")


def test_rungs(spark):
    assert ladder(spark, []) == {"xx": ("none", None), "yy": ("none", None)}
    assert ladder(spark, [A, B], [(100, True)])["xx"] == ("primary", 10)  # a link goes before what is nearer
    assert ladder(spark, [A, B], [(100, True), (200, False)], ["i"], [(10, "i")])["xx"] == ("corroborated", 10)
    assert ladder(spark, [A, B], mine=["i"], ilis=[(10, "i")])["xx"] == ("ili", 10)
    assert ladder(spark, [A, B], proposed=[100])["xx"] == ("llm", 10)
    assert ladder(spark, [A, B])["xx"] == ("fallback", 20)
    assert ladder(spark, [A])["xx"] == ("none", None)  # below the floor
    assert ladder(spark, [A, B], anchor="none") == {"xx": ("none", None), "yy": ("none", None)}


def test_override_needs_more_synsets_and_the_floor(spark):
    ilis = [(10, "i"), (20, "i"), (20, "j")]
    assert ladder(spark, [A, B], [(100, True)], ["i", "j"], ilis)["xx"] == ("ili_override", 20)
    assert ladder(spark, [A, B], [(100, True)], ["i", "j"], [*ilis, (10, "j")])["xx"] == ("corroborated", 10)
    assert ladder(spark, [A, B], [(100, True)], ["i"], ilis)["xx"] == ("corroborated", 10)
    low = (20, 200, "xx", 0, "a", "other", "far")
    assert ladder(spark, [A, low], [(100, True)], ["i", "j"], ilis)["xx"] == ("corroborated", 10)


def test_ties_margin_and_bonus(spark):
    same = [(10, 100, "xx", 0, "ab", None, "near"), (20, 200, "xx", 0, "a", None, "near"), (30, 300, "xx", 1, "A", None, "near")]
    assert ladder(spark, same, [(100, False), (200, False), (300, False)])["xx"] == ("primary", 10)  # earlier sense, then the longer of two words that begin alike
    assert ladder(spark, same, [(100, False), (200, True)])["xx"] == ("primary", 20)  # the stored target
    two = [(10, 100, "xx", 0, "ab", "x", "near"), (11, 100, "xx", 1, "ab", "the word itself", "near"), (12, 100, "xx", 2, "ab", "loosely a word", "near")]
    assert ladder(spark, two, [(100, True)])["xx"] == ("primary", 11)
    shown = roots.shown(spark.createDataFrame([(1, 100, True)], "anchor_id long, lexeme_id long, original boolean"), spark.createDataFrame([(1, "word", V["a"])], "anchor_id long, lemma string, vector array<double>"), spark.createDataFrame([(*t[:6], V[t[6]]) for t in two], SENSE))
    assert [round(r.effective - r.sim, 6) for r in shown.select("effective", "sim", F.lit(1)).collect()] == [0.02]
