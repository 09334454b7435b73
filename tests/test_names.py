import json

import pytest
from pyspark.sql import functions as F

from lexiweave.functions import romanize
from lexiweave.operators import names


def one(spark, make, *values, types=None):
    """The value of an expression over one row of texts."""
    df = spark.createDataFrame([values], types or ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


CATEGORIES = [
    ("Old English male given names", "Old English", ("GIVEN", "m")), ("German surnames", "German", ("SURNAME", "u")), ("Icelandic patronymics", "Icelandic", ("PATRONYMIC", "u")),
    ("Latin nomina gentilia", "Latin", ("SURNAME", "u")), ("Russian possessive surnames", "Russian", ("SURNAME", "u")), ("English surnames from Old English", "English", ("SURNAME", "u")),
    ("English terms derived from given names", "English", None), ("Polish female surnames", "German", None), ("Places in England", "English", None), ("english  Unisex given names", "English", ("GIVEN", "x")),
    ("Chinese renderings of English surnames", "Chinese", ("SURNAME", "u")), ("Korean renderings of English female given names", "Korean", ("GIVEN", "f")), ("Greek diminutives of Ancient Greek male given names", "Greek", ("GIVEN", "m")),
    ("Chinese renderings of English places", "Chinese", None), ("Russian patronymic surnames", "Russian", ("PATRONYMIC", "u")), (None, "English", None), ("English surnames", None, None), ("", "English", None),
]


def test_categories(spark):
    df = spark.createDataFrame([(i, c, g) for i, (c, g, _) in enumerate(CATEGORIES)], "i int, c string, g string")
    got = [r.k and tuple(r.k) for r in df.orderBy("i").select(names.category_kind(F.col("c"), F.col("g")).alias("k")).collect()]
    assert got == [k for _, _, k in CATEGORIES]


def printed(*cs):
    return [repr({"name": c, "kind": "other", "parents": []}) for c in cs]


def test_category_names(spark):
    cats = [*printed("German surnames", "O'Neil names"), "English surnames", "{'kind': 'other'}", None, ""]
    assert one(spark, names.category_names, cats, types="c array<string>") == ["German surnames", "O'Neil names", "English surnames"]
    assert one(spark, names.category_names, None, types="c array<string>") == []


SENSES = [
    ("accusative singular of Zmyrna", [], printed("Latin female given names"), "Latin", ("FORM_OF", "u", False)), ("genitive of Anna", None, None, "Polish", ("FORM_OF", "u", False)),
    ("a surname", ["masculine", "neuter"], printed("German surnames"), "German", ("SURNAME", "u", False)), ("a male surname", ["feminine"], printed("Polish male surnames"), "Polish", ("SURNAME", "m", False)),
    ("a female patronymic", ["masculine"], printed("Icelandic patronymics"), "Icelandic", ("PATRONYMIC", "f", False)), ("a female given name", [], printed("Terms with quotations"), "English", ("GIVEN", "f", False)),
    ("x", [], printed("English male given names", "English surnames"), "English", ("GIVEN", "m", True)), ("x", [], printed("English male given names", "English female given names"), "English", ("GIVEN", "x", False)),
    ("a given name, also a surname", None, None, "English", ("GIVEN", "u", True)), (None, ["alt-of"], None, None, ("OTHER", "u", False)), ("x", [None, " Alt-Of "], None, None, ("FORM_OF", "u", False)),
    ("a parish in X", None, None, "English", ("PLACE", "u", False)), ("a civil parish", None, None, "English", ("PLACE", "u", False)), ("a number of places", None, None, "en", ("PLACE", "u", False)), ("Xanten (a town in Y)", None, None, "en", ("PLACE", "u", False)),
]


def test_senses(spark):
    df = spark.createDataFrame([(i, *s[:4]) for i, s in enumerate(SENSES)], "i int, g string, t array<string>, c array<string>, l string")
    got = [tuple(r.k) for r in df.orderBy("i").select(names.classify_name(*[F.col(c) for c in "gtcl"]).alias("k")).collect()]
    assert got == [s[4] for s in SENSES]


@pytest.mark.parametrize(
    ("gloss", "want"),
    [("a male surname", "m"), ("a female patronymic", "f"), ("a male given name, feminine equivalent Christiane", "m"), ("A male or female given name.", "x"), ("a common-gender surname", "x"), ("A surname.", "u"), (None, "u"), ("a masculine or rare name", "m"), ("an epicene name", "x")],
)
def test_gender(spark, gloss, want):
    assert one(spark, names.gender, gloss) == want


def test_joined_gender(spark):
    for said, want in ((["u", "m"], "m"), (["m", "f"], "x"), (["u"], "u"), ([], "u"), (["x", "m"], "x")):
        assert one(spark, names.joined_gender, said, types="c array<string>") == want


MEANINGS = [
    ('a female given name, meaning "inspiration"', 'From somewhere ("other").', "cy", ("GLOSS_MEANING", "inspiration")), ("a male given name", 'From Old English ead ("wealth") + weard ("guardian").', "ang", ("ETYM_QUOTED", "wealth + guardian")),
    ("a female given name", 'From "x" ("stem") of the verb.', "ja", (None, None)), ("A surname.", "", "en", (None, None)), (None, None, None, (None, None)), ("x", 'See "Avon".', "en", (None, None)), ("x", 'From a ("b"). From c ("d").', "en", ("ETYM_QUOTED", "b")),
    ("x", 'From Gk. ca. a ("b") cf. Greek c ("d").', "en", ("ETYM_QUOTED", "b + d")), ("x", 'Perhaps ("derived from him").', "en", (None, None)), ("x", 'From a ("stem of the verb"), b ("light"), c ("Light").', "en", ("ETYM_QUOTED", "light")),
    ("x", "Literally “a  b,”.", "en", ("ETYM_MARKER", "a b")), ("x", 'via a ("1"), ("p"), ("q"), ("r"), ("s"), ("t")', "en", ("ETYM_QUOTED", "p + q + r + s")), ("meaning “??”", "", "en", (None, None)),
]


def test_meanings(spark):
    df = spark.createDataFrame([(i, *m[:3]) for i, m in enumerate(MEANINGS)], "i int, g string, e string, l string")
    channel, meaning = names.meaning_of(F.col("g"), F.col("e"), F.col("l"))
    got = [tuple(r) for r in df.orderBy("i").select(channel.alias("c"), meaning.alias("m")).collect()]
    assert got == [m[3] for m in MEANINGS]


def test_equivalents(spark):
    for gloss, want in (("a male given name, equivalent to English John", "John"), ("equivalent to English O'Neil-Smith.", "O'Neil-Smith"), ("equivalent to English john", None), ("a name", None), (None, None)):
        assert one(spark, names.english_equivalent, gloss) == want


def test_tokens(spark):
    for text, want in (("wealth, fortune + guardian of the light", ["wealth", "fortune", "guardian", "light"]), ("ﬁrefly", ["firefly"]), ("Bràvery bravery Bravery", ["bràvery", "bravery"]), (None, []), ("of the and", []), (" ".join(f"w{c}{c}" for c in "abcdefghijklmno"), [f"w{c}{c}" for c in "abcdefghijkl"])):
        assert one(spark, names.meaning_tokens, text) == want, text


TARGETS = [
    ("diminutive of the male given name Dafydd", [("DIMINUTIVE_OF", "Dafydd")]), ("pet form of Alexandra or Sandra, equivalent to English Sandy. Other", [("EQUIV_EN", "Sandy"), ("DIMINUTIVE_OF", "Alexandra"), ("DIMINUTIVE_OF", "Sandra"), ("DIMINUTIVE_OF", "equivalent")]),
    ("a male given name, feminine equivalent Daniela (rare)", [("FEM_EQUIV", "Daniela")]), ("variant of Ann, Anna, Anne and Annie", [("VARIANT_OF", "Ann"), ("VARIANT_OF", "Anna"), ("VARIANT_OF", "Anne")]), ("a surname", []), (None, []),
]


def test_targets(spark):
    for text, want in TARGETS:
        assert [tuple(x) for x in one(spark, names.trigger_targets, text)] == want, text


def form(text, *tags, **more):
    return {"form": text, "tags": list(tags), **more}


ENTRIES = [
    ({"forms": [form("slova", "romanization", "genitive"), form("slovo", "romanization", "canonical")]}, "Cyrl", "slovo"), ({"forms": [form("x", "romanization")]}, "Latn", None), (None, "Cyrl", None), ({}, "Cyrl", None),
    ({"forms": [form("ganeunghada", "romanization"), form("가능해", "informal", roman="ganeunghae", source="conjugation")]}, "Kore", "ganeunghada"), ({"forms": [form("x", "romanization", source="conjugation"), form("canonical", "Romanization")]}, "Kore", "canonical"),
    ({"forms": [form("a" * 500, "romanization")]}, "Cyrl", None), ({"forms": [form("  na  chalo ", "romanization")]}, "Cyrl", "na chalo"), ({"forms": [form("kamal", "romanization")]}, "Deva", "kamal"),
    ({"forms": [form("x", roman="yy")], "head_templates": [{"args": {"1": "-", "tr": "zz"}}]}, "Arab", "zz"), ({"forms": [form("x", roman="yy")], "head_templates": [{"args": {"tr": "zz"}}]}, "Jpan", "yy"), ({"forms": [form("x", roman="yy")]}, "Zzzz", None),
    ({"sounds": [{"tags": ["Min-Nan", "Hokkien"], "zh_pron": "a"}, {"tags": ["Mandarin", "Pinyin"], "ipa": "x", "zh_pron": "guāng"}]}, "Hani", "guāng"), ({"sounds": [{"tags": ["Mandarin", "Cantonese"], "zh_pron": "a"}]}, "Hani", None), ({"sounds": [{"zh_pron": "a"}]}, "Hani", None),
]


def test_romanization_of_entries(spark):
    df = spark.createDataFrame([(i, None if e is None else json.dumps(e, ensure_ascii=False), s) for i, (e, s, _) in enumerate(ENTRIES)] + [(99, "no json", "Cyrl")], "i int, e string, s string")
    got = [r.x for r in df.orderBy("i").select(romanize.romanization(F.col("e"), F.col("s")).alias("x")).collect()]
    assert got == [w for _, _, w in ENTRIES] + [None]


def test_transliteration():
    cyrillic = {"свет": "svet", "щит": "shchit", "ёлка": "yolka", "мужчина": "muzhchina", "Москва": "Moskva", "нью-йорк": "nyu-york", "Щука": "Shchuka", "кни́га": "kniga", "светא": None, "ѣ": None, "": None}
    greek = {"φως": "fos", "θάλασσα": "thalassa", "ψυχή": "psychi", "Ελλάδα": "Ellada", "Ψ": "Ps"}
    assert {w: romanize.transliterate(w, "Cyrl") for w in cyrillic} == cyrillic
    assert {w: romanize.transliterate(w, "Grek") for w in greek} == greek
    assert all(romanize.transliterate("क", s) is None for s in ("Deva", "Arab", "Latn", None))
