import pytest

from lexiweave.llm import lookalike

SAME = [
    ("ｐａｆ－x", "paf-x"), ("café", "café"), ("pаf", "paf"), ("a​b­c﻿", "abc"), ("a b", "a b"), ("ﬁﬆ", "fist"), ("ёж", "ёж"), ("рос", "poc"),
    ("ｸ"[:0] + "ヘや", "へや"), ("کم", "كم"), ("όο", "όο"), ("한", "한"), ("क़", "क़"), ("a‐b", "a-b"), ("Ѕo", "So"), ("ﾊﾞｽ", "バス"), ("𝐛𝒐𝖔𝗸", "book"), ("ⅩⅤⅰ", "XVi"), ("Օհ", "Oh"), ("ᎪᏴ", "AB"), ("ﻛﻢ", "کم"), ("a\u200cb", "ab"), ("پ\u200c\u200cک", "پ\u200cک"), ("ў", "у\u0306"), ("ΐ", "ι\u0308\u0301"), ("ќ\U0001f642", "к\u0301\U0001f642"), ("y\u0306", "ў"),
]
DIFFERENT = [("paf", "Paf"), ("cafe", "café"), ("a b", "ab"), ("a-b", "ab"), ("σ", "ς"), ("o", "0"), ("می‌رود", "میرود"), ("lll", "III"), ("σο", "οσ"), ("ии", "пп"), ("æ", "ae"), ("a\u0301", "a"), ("可", "司")]


def pairs(spark, values, scope=1):
    df = spark.createDataFrame([(i, scope, v, "clash", "clash") for i, v in enumerate(values)], "id long, lang int, lemma string, value string, look string")
    return sorted((r.id_a, r.id_b) for r in lookalike.look_pairs(df, "lang", ["lemma"], "id").collect())


@pytest.mark.parametrize("same", [True, False])
def test_what_looks_the_same(spark, same):
    cases = SAME if same else DIFFERENT
    df = spark.createDataFrame([(2 * i + j, i, p[j]) for i, p in enumerate(cases) for j in (0, 1)], "id long, lang int, lemma string")
    got = {(r.id_a // 2) for r in lookalike.look_pairs(df, "lang", ["lemma"], "id").collect()}
    assert got == (set(range(len(cases))) if same else set())


def test_pairs_over_repeated_rows_nulls_and_scopes(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (2, 1, "ａb"), (3, 1, "ab"), (4, 2, "ａb"), (5, 1, None), (6, None, "ａb"), (7, None, "ab"), (8, 1, ""), (9, 1, "​")], "id long, lang int, lemma string")
    got = sorted((r.id_a, r.id_b) for r in lookalike.look_pairs(df, "lang", ["lemma"], "id").collect())
    assert got == [(1, 2), (2, 3), (8, 9)]
    assert pairs(spark, []) == []


def test_hot_values_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("lexiweave.skew.HOT_ROWS", 5)
    values = ["ab"] * 40 + ["ａb"] * 7 + ["a​b"] * 2 + ["q"] * 9
    assert pairs(spark, values) == sorted((i, j) for i in range(58) for j in range(i + 1, 58) if values[i] != values[j] and "q" not in (values[i], values[j]))


def test_canonical_form_is_the_commonest(spark):
    df = spark.createDataFrame([(1, 1, "ａb"), (2, 1, "ab"), (3, 1, "ab"), (4, 1, None), (5, None, "ａb"), (6, 1, "x" * 100_000)], "id long, lang int, lemma string")
    got = {r.id: r.canonical_lemma for r in lookalike.unify(df, "lang", ["lemma"]).collect()}
    assert got == {1: "ab", 2: "ab", 3: "ab", 4: None, 5: "ａb", 6: "x" * 100_000}
    assert lookalike.unify(df.limit(0), "lang", ["lemma"]).count() == 0
