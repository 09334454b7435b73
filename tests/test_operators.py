import random

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import unicode_keys
from lexiweave.operators import edges, expansion, lookup, measures, merging, names, ordering, propagation, taxonomy, validation, vectors
from lexiweave.skew import hot_limit, salted_join, skew_join

# (part of speech, tags, lemma, definition, language, tier)
TIERS = [
    ("noun", [], "fire", "burning", "en", "C"), ("noun", [], "fire", "ab", "en", "A"), ("noun", [], "", "burning", "en", "A"), ("noun", [], None, "burning", "en", "A"), ("noun", [], "fire", None, "en", "A"),
    ("prep", [], "of", "belonging", "en", "A"), ("noun", ["Form-Of "], "fires", "plural", "en", "A"), ("noun", [], "s620", "a steel", "en", "A"), ("suffix", [], "-ing", "ending", "en", "A"), ("noun", [], "-x", "an edge", "en", "A"),
    ("noun", [], "Det.", "short for", "en", "A"), ("noun", [], "é", "a letter", "en", "A"), ("noun", [], "я", "a letter", "ru", "A"), ("noun", [], "火", "fire", "ja", "C"), ("noun", [], "א", "a letter", "he", "C"),
    ("name", [], "paris", "a city", "en", "B"), ("num", [], "six", "a number", "en", "B"), ("noun", ["archaic"], "fire", "burning", "en", "B"), ("noun", [], "red fox", "an animal", "en", "B"), ("noun", [], "Fox", "an animal", "en", "B"),
    ("noun", [], "FOX", "an animal", "en", "C"), ("noun", [], "Haus", "a house", "de", "C"), ("noun", [], "किताब", "a book", "hi", "C"), ("noun", [], "किताब", "a book", "en", "A"), ("noun", [], "می‌رود", "goes on", "fa", "C"),
    ("noun", [], "o'clock", "by the clock", "en", "C"), ("root", [], "abc", "a root", "he", "A"), ("noun", None, "ice-cream", "a sweet", "en", "C"), ("noun", [None, ""], "ice", "frozen", "en", "C"),
]


def test_tiers(spark):
    df = spark.createDataFrame([(i, *t[:5]) for i, t in enumerate(TIERS)], "i int, part_of_speech string, raw_tags array<string>, lemma string, definition string, language_code string")
    got = {r.i: r.tier for r in taxonomy.classify(df).collect()}
    assert [TIERS[i] for i, t in got.items() if t != TIERS[i][5]] == []


def test_sole_trigger(spark):
    df = spark.createDataFrame([(1, "noun", ["alt-of"], "fire", "burning"), (2, "noun", ["alt-of", "vulgar"], "fire", "burning"), (3, "prep", ["alt-of"], "of", "belonging")], "i int, part_of_speech string, raw_tags array<string>, lemma string, definition string").withColumn("language_code", F.lit("en"))
    assert {r.i: r.sole_alt for r in taxonomy.classify(df).collect()} == {1: True, 2: False, 3: False}


def test_keys(spark):
    cases = [("Ēx ", "la", "ex"), ("Café", "en", "café"), ("İ", "en", "i"), ("Straße", "de", "strasse"), ("ｆｏｘ", "en", "fox"), ("кни́га", "ru", "книга"), ("क़लम", "hi", unicode_keys.fold_text("क़लम")), ("كتاب‌ي", "fa", "کتابی"), (None, "en", None), ("", "en", ""), ("fox", None, "fox")]
    df = spark.createDataFrame([(i, v, g) for i, (v, g, _) in enumerate(cases)], "i int, v string, g string")
    assert [r.k for r in unicode_keys.with_lemma_key(df, "v", "g", "k").orderBy("i").collect()] == [c[2] for c in cases]
    assert [r.k for r in df.orderBy("i").select(unicode_keys.lemma_key("v", "g").alias("k")).collect()] == [c[2] for c in cases]


def test_text_measures(spark):
    cases = [("starfish", "fishing", 4), ("abc", "xyz", 0), ("", "a", 0), (None, "a", None), ("ab" * 300, "ba" * 300, 599)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    assert [r.n for r in df.orderBy("i").select(unicode_keys.longest_common_substring("a", "b").alias("n")).collect()] == [c[2] for c in cases]
    texts = [(" Ｆｏx\u00a0", "fox"), ("STRASSE ß", "strasse ss"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in df.orderBy("i").select(unicode_keys.normalize_text("t").alias("k")).collect()] == [t[1] for t in texts]


def test_display_split(spark):
    cases = [(["a", "b"], "b", "a"), (["of places", "of places: a town"], "of places: a town", ""), ([" ", None, "x"], "x", ""), (None, None, ""), (["1", "2", "3", "4", "5"], "5", "2 > 3 > 4")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, g array<string>")
    d, p = lookup.display_split(F.col("g"))
    assert [(r.d, r.p) for r in df.orderBy("i").select(d.alias("d"), p.alias("p")).collect()] == [c[1:] for c in cases]


@pytest.mark.parametrize("block", [1, 64 << 20])
def test_nearest_equals_brute_force(spark, block):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], "ab"[i % 2]) for i in range(300)] + [(900, None, "a"), (901, [0.0] * 6, "a"), (902, [1.0] * 6, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, lang string").repartition(5)

    def sim(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 4)

    import numpy as np

    f32 = {i: list(map(float, np.array(v, np.float32))) for i, v, _ in rows[:300]}
    got = {}
    for x in vectors.nearest(df.filter("id % 100 = 0"), df, 4, "lang", query_bytes=block, digits=4).collect():
        got.setdefault(x.query_id, []).append((x.row_id, x.sim))
    for q in (0, 100, 200):
        want = sorted(((-sim(f32[q], f32[i]), i) for i in f32 if i != q and i % 2 == q % 2))[:4]
        assert sorted(got[q], key=lambda t: (-t[1], t[0])) == [(i, -s) for s, i in want]
    assert 901 not in got and vectors.nearest(df.limit(0), df, 4).count() == 0


def test_skewed_joins(spark, monkeypatch):
    monkeypatch.setattr("lexiweave.skew.HOT_ROWS", 10)
    assert hot_limit(5) == 10 and hot_limit(10**9) == 10**6
    many = spark.createDataFrame([(i, "h" if i % 2 else f"k{i % 5}") for i in range(60)], "i int, k string")
    one = spark.createDataFrame([("h", 1), ("k0", 2), ("zz", 3)], "k string, v int")
    hot = spark.createDataFrame([("h",)], "k string")
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(many, one, "k", hot, how).select("i", "k", "v").collect())) == sorted(map(str, many.join(one, "k", how).select("i", "k", "v").collect()))
    few = one.union(one)
    assert sorted(salted_join(many, few, "k", hot, "i").select("i", "k", "v").collect()) == sorted(many.join(few, "k").select("i", "k", "v").collect())


def test_running_totals(spark):
    r = random.Random(2)
    rows = [(g, i, r.randint(0, 9)) for g in ("a", "b", None) for i in r.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(6)
    got = {(x.g, x.i): (x.total, x.place) for x in ordering.places(ordering.running_totals(df, ["g"], ["i"], F.col("v")), ["g"], ["i"]).collect()}
    for g in ("a", "b", None):
        total = 0
        for n, (_, i, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1]), 1):
            total += v
            assert got[g, i] == (total, n)
    assert ordering.places(df.limit(0), ["g"], ["i"]).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([("g", 1.0, False), ("g", 2.0, True), ("g", 2.0, False), ("g", 3.0, True), ("h", 1.0, True), ("g", None, True)], "g string, s double, p boolean")
    assert {r.g: (r.n_pos, r.n_neg, r.auc) for r in measures.auc(df, ["g"], "s", "p").collect()} == {"g": (2, 2, 0.875), "h": (1, 0, None)}
    xy = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 20.0), ("g", 2.0, 15.0), ("g", 9.0, 30.0), ("g", 9.0, None)], "g string, a double, b double")
    assert measures.spearman(xy, ["g"], "a", "b").collect()[0].rho == pytest.approx(0.948683, abs=1e-6)
    sc = spark.createDataFrame([("g", 0.9, 1), ("g", 0.5, 2), ("g", 0.45, 3), ("h", 1.0, 1)], "g string, s double, i int")
    assert [tuple(r) for r in measures.cliff(sc, ["g"], "s", "i").collect()] == [("g", 0.4, 1)]
    fam = spark.createDataFrame([(["light", "lights", "dark", "lighting", "dar"],)], "w array<string>").select(measures.family_heads(F.col("w")).alias("n")).first().n
    assert fam == [3, 1, 1]


def test_merging(spark):
    s = "k string, a string, b int"
    old = spark.createDataFrame([("x", "1", None), ("y", None, 2), (None, "n", 1)], s)
    new = spark.createDataFrame([("y", "new", 3), ("z", "4", 4), (None, "n", 1)], s)
    key = lambda rows: {r.k: tuple(r)[1:] for r in rows}
    assert key(merging.insert_missing(old, new, ["k"]).collect()) == {"x": ("1", None), "y": (None, 2), None: ("n", 1), "z": ("4", 4)}
    assert key(merging.fill_missing(old, new, ["k"], ["a", "b"]).collect()) == {"x": ("1", None), "y": ("new", 2), None: ("n", 1), "z": ("4", 4)}
    assert key(merging.upsert(old, new, ["k"], [F.desc("b")]).collect()) == {"x": ("1", None), "y": ("new", 3), None: ("n", 1), "z": ("4", 4)}
    assert {r.k: r.outcome for r in merging.differences(old, new, ["k"], ["a", "b"]).collect()} == {"x": "removed", "y": "changed", None: "same", "z": "added"}
    rows = spark.createDataFrame([(1, "A", "a"), (2, "a", "a"), (3, "B", "b"), (4, "B2", "b")], "i int, o string, n string")
    assert {r.i: r.action for r in merging.rekeyed(rows, [], "o", "n", "i", 4).collect()} == {1: "collapse", 2: "same", 3: "update", 4: "collapse"}
    p, c = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, pid int")
    assert sorted(r.c for r in merging.cascade(p, c, "id", "pid").collect()) == [10, 12]
    assert {r.c: r.pid for r in merging.cascade(p, c, "id", "pid", True).collect()} == {10: 1, 11: None, 12: None}
    best = spark.createDataFrame([(1, "k", "rejected", "high"), (2, "k", "reviewed", "low"), (3, "k", "reviewed", "medium"), (4, "k", None, None)], "id int, k string, review_status string, confidence string")
    assert [tuple(r) for r in merging.keep_best(best, ["k"], "id").collect()] == [("k", 3, 4)]


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", "x", "0.5"), (2, " ", "z", "7"), (3, None, None, "q"), (4, "a", "x", None)], "i int, a string, b string, c string")
    got = sorted(tuple(r) for r in validation.violations(df, "i", [validation.required("a"), validation.one_of("b", ("x", "y")), validation.within("c", 0, 1)]).collect())
    assert got == [(2, "a: missing"), (2, "b: not allowed"), (2, "c: out of range"), (3, "a: missing"), (3, "c: out of range")]
    assert [tuple(r) for r in validation.repeated_keys(df, ["a"]).collect()] == [("a", 2)]
    assert [r.i for r in validation.unresolved(df, "i", "b", spark.createDataFrame([("x",)], "k string"), "k").collect()] == [2]
    with pytest.raises(ValueError):
        validation.allowed_updates({"a": 1, "q": 2}, ("a",))


def test_edges(spark):
    m = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a"), ("h", "z"), (None, "q")], "g string, w string")
    assert sorted(tuple(r) for r in edges.comembers(m, "g", "w", 5).collect()) == [("g", "a", "b")]
    first, kept = edges.routed(F.col("w"))
    got = spark.createDataFrame([([10, 41, 67, 67, 41],), ([],), (None,)], "w array<int>").select(first.alias("f"), kept.alias("k")).collect()
    assert [(r.f, r.k) for r in got] == [(3, [2, 3, 4, 5]), (None, []), (None, None)]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "q")], "i int, k string")
    own, other = spark.createDataFrame([("a", 5), ("a", 4)], "k string, target_id int"), spark.createDataFrame([("a", 9), ("b", 8)], "k string, target_id int")
    res = {r.i: (r.target_id, r.found_in) for r in edges.resolve(rows, "k", [("own", own), ("other", other)], 4).collect()}
    assert res == {1: (4, "own"), 2: (8, "other"), 3: (None, "unresolved"), 4: (None, "unresolved")}


@pytest.mark.parametrize("block", [20, 500_000])
def test_best_overlap_equals_all_pairs(spark, block):
    r = random.Random(3)
    row = lambda i: (i, r.choice("ab"), [r.choice("pqrstuvwxyz") for _ in range(r.randint(0, 6))])
    left, right = [row(i) for i in range(40)] + [(90, None, ["p"]), (91, "a", None), (92, "c", ["p"])], [row(100 + i) for i in range(80)] + [(190, None, ["p"]), (191, "a", [None])]
    df = lambda rows, i, t: spark.createDataFrame(rows, f"{i} long, g string, {t} array<string>").repartition(3)
    got = {x.i: (x.j, x.n_shared) for x in edges.best_overlap(df(left, "i", "t"), df(right, "j", "u"), "g", "i", "j", "t", "u", block).collect()}
    want = {}
    for i, g, t in left:
        n, j = min(((-len({*(t or ())} & {*u} - {None}), j) for j, h, u in right if g and h == g), default=(0, 0))
        if n:
            want[i] = (j, -n)
    assert got == want


def test_every_name_meets_every_other_sense_of_its_language(spark, tiny):
    from collections import defaultdict

    from lexiweave.plans.graphs import best_overlap
    from oracle_check import connect

    rows = connect(tiny).sql("SELECT s.id, x.language_id, x.part_of_speech, list_distinct(regexp_extract_all(lower(s.definition), '\\p{L}{4,}')) FROM senses s JOIN lexemes x ON x.id = s.lexeme_id").fetchall()
    others, want = defaultdict(list), {}
    for i, g, p, t in rows:
        if p and p != "name":
            others[g].append((i, {*(t or ())}))
    for i, g, p, t in rows:
        n, j = min(((-len({*(t or ())} & u), j) for j, u in others[g]), default=(0, 0)) if p == "name" else (0, 0)
        if n:
            want[i] = (j, -n)
    assert {x.sense_id: (x.other_id, x.n_shared) for x in best_overlap(spark, tiny).collect()} == want
    assert any(i % 10 for i in want)


def brute_trees(edge_rows, roots, width, depth, sims, alpha=0.35, decay=0.02, step=0.03):
    def fam(a, b):
        short = min(len(a), len(b))
        n = max(4, -(-short * 6 // 10))
        return short >= n and a[:n] == b[:n]

    kids = {}
    for src in {e[0] for e in edge_rows}:
        best = {}
        for s, d, t, sc, q in edge_rows:
            if s == src and d != s and (d not in best or (t, q) < best[d][:2]):
                best[d] = (t, q, sc)
        kept = sorted((t, q, d, round(sc, 6)) for d, (t, q, sc) in best.items())[: max(3 * width, width + 5)]
        by = sorted((-sc, d) for _, _, d, sc in kept)
        out = [(-(round(-s - step * sum(fam(d, x) for _, x in by[:i]), 6)), d) for i, (s, d) in enumerate(by)]
        kids[src] = [(d, -s, p) for p, (s, d) in enumerate(sorted(out)[:width], 1)]
    tree = {}
    for root in roots:
        seen, level = {root: (0, None, 1.0)}, [(root, [])]
        for n in range(1, depth + 1):
            cand = {}
            for node, line in level:
                for d, sc, p in kids.get(node, []):
                    if d not in seen:
                        s = round(max(0.0, (1 - alpha) * sc + alpha * sims.get((root, d), 0.0) - decay * n), 6)
                        key = (-s, line, p)
                        if d not in cand or key < cand[d][0]:
                            cand[d] = (key, node, line, s)
            level = []
            for par in {c[1] for c in cand.values()}:
                for i, (d, c) in enumerate(sorted(((d, c) for d, c in cand.items() if c[1] == par), key=lambda x: (-x[1][3], x[0])), 1):
                    seen[d] = (n, par, c[3])
                    level.append((d, c[2] + [i]))
        tree[root] = seen
    return tree


def test_trees_equal_a_walk(spark):
    r = random.Random(8)
    nodes = [f"{a}{b}word" for a in "abcd" for b in "xyzw"]
    edge_rows = [(r.choice(nodes), r.choice(nodes), r.randint(0, 2), r.randint(0, 20) / 20, i) for i in range(150)]
    sims = {(a, b): r.randint(0, 10) / 10 for a in nodes[:4] for b in nodes if r.random() < 0.5}
    e = spark.createDataFrame(edge_rows, "src string, dst string, tier int, score double, seq int")
    kids = expansion.children(e, 3)
    roots = spark.createDataFrame([(n,) for n in [*nodes[:4], "lonely"]], "node string")
    origin = spark.createDataFrame([(*k, v) for k, v in sims.items()], "root string, node string, sim double")
    got = {}
    for x in expansion.grow(roots, kids, kids, origin, 3).collect():
        got.setdefault(x.root, {})[x.node] = (x.depth, x.parent, x.score)
    assert got == brute_trees(edge_rows, [*nodes[:4], "lonely"], 3, 3, sims)
    assert max(len(t) for t in got.values()) <= 40


def test_children_are_ranked_among_all_targets(spark):
    # the best targets come last by tier and row; equal scores go by tier, then row
    e = [("hub", f"{i:03}low", 0, 0.1, i) for i in range(100)] + [("hub", f"{i}best", 2, 0.9 - i / 100, 200 + i) for i in range(3)] + [("few", "only", 1, 0.5, 300)]
    got = sorted((r.src, r.place, r.dst, r.score) for r in expansion.children(spark.createDataFrame(e, "src string, dst string, tier int, score double, seq int"), 5).collect())
    assert got == [("few", 1, "only", 0.5), ("hub", 1, "0best", 0.9), ("hub", 2, "1best", 0.89), ("hub", 3, "2best", 0.88), ("hub", 4, "000low", 0.1), ("hub", 5, "001low", 0.1)]
    ties = spark.createDataFrame([("s", f"{i:03}tie", 1 if i < 40 else 0, 1.0, i) for i in range(60)], "src string, dst string, tier int, score double, seq int")
    assert [r.dst for r in expansion.children(ties, 5).orderBy("place").collect()] == [f"{i:03}tie" for i in range(40, 45)]


def test_children_are_likened_and_filled(spark):
    v = spark.createDataFrame([("root", [1.0, 0.0]), ("near", [0.8, 0.6]), ("away", [-1.0, 0.0]), ("none", [0.0, 0.0])], "node string, vector array<float>")
    e = spark.createDataFrame([("root", d, 0, 0.9, i) for i, d in enumerate(["near", "away", "none", "missing"])] + [("missing", "root", 0, 0.9, 9)], "src string, dst string, tier int, score double, seq int")
    got = expansion.likened(e, v, 5)
    assert {(r.src, r.dst): (r.score, r.tier) for r in got.collect()} == {("root", "near"): (0.8, 0), ("root", "away"): (0.0, 0), ("root", "none"): (0.0, 0), ("root", "missing"): (0.0, 0), ("missing", "root"): (0.0, 0)}
    # six targets are collected for k = 1: four edges and two of the nearest; a source without edges has the nearest alone
    near = spark.createDataFrame([("root", "near", 0.8), ("root", "root", 1.0), ("root", "aaaa", 0.85), ("root", "bbbb", 0.7), ("root", "cccc", 0.6), ("lone", "bbbb", 0.3), ("lone", "cccc", 0.4)], "src string, dst string, sim double")
    kids = lambda k: sorted((r.src, r.place, r.dst, r.score) for r in expansion.children(got, k, near=near).collect())
    assert kids(1) == [("lone", 1, "cccc", 0.4), ("missing", 1, "root", 0.0), ("root", 1, "aaaa", 0.85)]
    assert [x[2] for x in kids(6) if x[0] == "root"] == ["aaaa", "near", "bbbb", "cccc", "away", "missing"]
    many = spark.createDataFrame([("root", f"{i}edge", 0, 0.1, i) for i in range(6)], "src string, dst string, tier int, score double, seq int")
    assert [r.dst for r in expansion.children(many, 1, near=near).filter("src = 'root'").collect()] == ["0edge"]


def test_sources_without_edges_have_children(spark, tiny):
    from lexiweave.plans.graphs import concept_edges, concept_vectors, expand_single

    n = {r.src: r.n for r in expand_single(spark, tiny).groupBy("src").agg(F.count("*").alias("n")).collect()}
    with_vector = {r.node for r in concept_vectors(spark, tiny).select("node").collect()}
    assert with_vector and all(n.get(x) == 5 for x in with_vector)
    assert with_vector - {r.src for r in concept_edges(spark, tiny).select("src").distinct().collect()}


def test_components(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z", "y"), ("z", "x"), (None, "q"), ("s", "s")]
    got = {r.node: r.component for r in propagation.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"x": "x", "y": "x", "z": "x", "s": "s"}


def test_names(spark):
    cases = [("a male given name", "GIVEN", "m"), ("a surname, also a given name", "GIVEN", "u"), ("a surname", "SURNAME", "u"), ("a patronymic", "PATRONYMIC", "u"), ("a small town", "PLACE", "u"), ("plural of x", "FORM_OF", "u"),
             ("a male given name, feminine equivalent name Dani", "GIVEN", "m"), ("", "OTHER", "u"), (None, "OTHER", "u"), ("a female name", "GIVEN", "f")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, g string")
    assert [(r.k, r.s) for r in df.orderBy("i").select(names.name_type(F.col("g")).alias("k"), names.gender(F.coalesce("g", F.lit(""))).alias("s")).collect()] == [c[1:] for c in cases]
    rows = spark.createDataFrame([("a", 1, 5, "X", "m1", "m", None), ("a", 0, 9, "Y", "m2", "u", "r9"), ("a", 0, 7, "Z", "m3", "f", "r7")], "k string, rank int, row_id long, channel string, meaning string, gender string, romanization string")
    assert [tuple(r) for r in names.name_groups(rows, ["k"]).collect()] == [("a", 7, "Z", "m3", "x", 3, "r7")]


def test_stems(spark):
    pairs = [("light", "lighted", True), ("light", "lights", True), ("luminous", "luminosity", True), ("light", "night", False), ("cat", "car", False), ("er", "er", True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.orderBy("i").select(vectors.same_stem(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0:2] == [True, True] and got[3:] == [False, False, True]
