"""Queries of the language-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.functions.keys import slug_key
from lexiweave.llm import bpe, components, langid, ledger, lookalike, mixing
from lexiweave.session import table


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "synonym")
    return links.select(slug_key("source_concept_slug").alias("a"), slug_key("target_concept_slug").alias("b"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_pairs(_synonyms(spark, d), "a", "b", "concept_slug", "group_slug")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups have how many members."""
    groups = p1_found(spark, d).groupBy("group_slug").agg(F.count("*").alias("n_members"))
    return groups.groupBy("n_members").agg(F.count("*").alias("n_groups"))


_LOOKS = ["lemma", "normalized_lemma"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.look_pairs(table(spark, d, "lexemes"), "language_id", _LOOKS, "id")
    return pairs.select("field", F.col("id_a").alias("lexeme_id_a"), F.col("id_b").alias("lexeme_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The values that look like another one, each with the canonical form of its class and the counts of both."""
    classes = lookalike.look_classes(table(spark, d, "lexemes"), "language_id", _LOOKS, Scratch(spark, "looks"))
    return classes.filter("n_forms > 1").withColumnRenamed("scope", "language_id")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Each lexeme with both texts in their canonical forms."""
    rows = table(spark, d, "lexemes").select("id", "language_id", *_LOOKS)
    return lookalike.unify(rows, "language_id", _LOOKS).select("id", "canonical_lemma", "canonical_normalized_lemma")


def _options(spark: SparkSession, d: str) -> tuple[ledger.Ledger, DataFrame]:
    """The options reach the ledger by the year in which they were served."""
    return ledger.ledger_of(table(spark, d, "sense_options"), ["language_code", "word"], "definition", "sense_id", F.year("served_at"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.collapsed(*_options(spark, d)).select(F.col("kept_id").alias("kept_sense_id"), F.col("row_id").alias("sense_id"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each remaining option with the number of its copies."""
    return ledger.copies(_options(spark, d)[0]).withColumnRenamed("kept_id", "sense_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids and offsets give its text back; the bytes are compared by a hash."""
    docs = table(spark, d, "documents")
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), "doc_id", "text"), "doc_id")
    j = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("want")).join(back, "doc_id")
    return j.select("doc_id", (F.col("want") == F.col("text")).alias("same"))


def _mixes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    sized = Scratch(spark, "tokens").write(bpe.count_tokens(docs, ["doc_id", "source"], "text"), "sized")
    return mixing.mix_sources(sized, table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return _mixes(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source was meant to have and the one it has."""
    return mixing.actual_shares(*_mixes(spark, d))


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """The targets of each mix, the documents of each source, and whether the mix keeps to the repeats."""
    shares = mixing.actual_shares(*_mixes(spark, d))
    return shares.select("mix_name", "source", "target_share", "max_repeats", "source_docs", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents with the code of their label, their segments)."""
    rows = langid.language_rows(table(spark, d, "languages"))
    code = langid.label_codes(F.col("lang"), [(c, n) for c, n, _ in rows])
    docs = table(spark, d, "documents").select("doc_id", "text", code.alias("code"))
    model = langid.fit(langid.labelled_sample(docs, "doc_id", "text", F.col("code"), len(rows)), [(c, s) for c, _, s in rows])
    return docs, langid.segment_languages(docs, ["doc_id", "code"], "text", model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    _, segments = _languages(spark, d)
    wrong = F.col("code").isNull() | (F.col("n_segments") > 1) | (F.col("code") != F.col("lang"))
    return segments.filter(wrong).select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's segments with their confidence."""
    return _languages(spark, d)[1].drop("code")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language with a confidence."""
    return langid.document_languages(_languages(spark, d)[1], "doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_sizes, p5_found, p5_classes, p5_canonical, p7_found, p7_counts, p8_ids, p8_roundtrip, p9_mix, p9_shares, p9_caps, p10_found, p10_segments, p10_documents)
}


def _slug(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


_GROUPS = f"""WITH RECURSIVE pairs AS (SELECT {_slug('source_concept_slug')} AS a, {_slug('target_concept_slug')} AS b FROM concept_relationships
  WHERE {_slug('relationship_type')} = 'synonym'),
links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) WHERE a IS NOT NULL AND b IS NOT NULL),
reach(v, w) AS (SELECT a, a FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.w),
found AS (SELECT v AS concept_slug, min(w) AS group_slug FROM reach GROUP BY v)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Look-alikes as they are found in dictionaries, and what they look like; characters in order of their scripts.
_ALIKE = ("асеорхуіѕјһԁԛԝӏАВЕЅІЈКМНОРСТХУονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧكىيヘベペ", "aceopxyisjhdqwlABESIJKMHOPCTXYovpABEZHIKMNOPTYXکییへべぺ")


def _chars(*ranges: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b))


def _look(c: str) -> str:
    """Composed, with ligatures spelt, look-alikes and full-width forms mapped, and what shows nothing left out."""
    for k, v in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        c = f"replace({c}, '{k}', '{v}')"
    spaces, hidden = _chars((0xA0, 0xA1), (0x2000, 0x200B), (0x202F, 0x2030), (0x205F, 0x2060), (0x3000, 0x3001)), _chars((0xAD, 0xAE), (0x34F, 0x350), (0x61C, 0x61D), (0x180B, 0x180F), (0x200B, 0x2010), (0x202A, 0x202F), (0x2060, 0x2070), (0xFEFF, 0xFF00))
    source = _ALIKE[0] + _chars((0xFF01, 0xFF5F)) + spaces + "‐‑‒" + hidden
    target = _ALIKE[1] + _chars((0x21, 0x7F)) + " " * len(spaces) + "---"
    return f"nfc_normalize(translate(nfc_normalize({c}), {_quoted(source)}, {_quoted(target)}))"


def _look_pairs(f: str) -> str:
    return f"""SELECT '{f}' AS field, a.id AS lexeme_id_a, b.id AS lexeme_id_b FROM k_{f} a JOIN k_{f} b
  ON a.language_id = b.language_id AND a.look = b.look AND a.id < b.id AND a.{f} <> b.{f}"""


_BARE = r"upper(regexp_replace({0}, '[\s\p{{Z}}\p{{P}}\p{{Cc}}]+', '', 'g'))"
_OPTION_KEYS = f"""WITH keyed AS (SELECT sense_id, {_BARE.format('language_code')} AS l, {_BARE.format('word')} AS w,
  list_sort(list_filter(list_transform(string_split_regex(definition, '[;；]'), lambda p: {_BARE.format('p')}), lambda p: p <> '')) AS d
  FROM sense_options WHERE regexp_replace(definition, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', '', 'g') <> ''),
kept AS (SELECT sense_id, min(sense_id) OVER (PARTITION BY l, w, d) AS kept_sense_id, count(*) OVER (PARTITION BY l, w, d) AS n FROM keyed)"""

_LOOK_FIELDS = "(" + " UNION ALL ".join(f"SELECT '{f}' AS field, id, language_id, {f} AS value, {_look(f)} AS look FROM lexemes WHERE {f} IS NOT NULL" for f in ("lemma", "normalized_lemma")) + ")"
_LOOK_CLASSES = f"""WITH counts AS (SELECT field, language_id, value, look, count(*) AS n_rows FROM {_LOOK_FIELDS} GROUP BY ALL),
classes AS (SELECT *, first_value(value) OVER (PARTITION BY field, language_id, look ORDER BY n_rows DESC, value) AS canonical, count(*) OVER (PARTITION BY field, language_id, look) AS n_forms FROM counts)"""
SQL = {
    "p5_classes": f"{_LOOK_CLASSES} SELECT field, language_id, value, canonical, n_rows, n_forms FROM classes WHERE n_forms > 1",
    "p5_canonical": f"""{_LOOK_CLASSES} SELECT x.id, a.canonical AS canonical_lemma, b.canonical AS canonical_normalized_lemma FROM lexemes x
  LEFT JOIN classes a ON a.field = 'lemma' AND a.value = x.lemma AND a.language_id IS NOT DISTINCT FROM x.language_id
  LEFT JOIN classes b ON b.field = 'normalized_lemma' AND b.value = x.normalized_lemma AND b.language_id IS NOT DISTINCT FROM x.language_id""",
    "p1_found": f"{_GROUPS} SELECT * FROM found",
    "p1_sizes": f"{_GROUPS}, sized AS (SELECT group_slug, count(*) AS n_members FROM found GROUP BY 1) SELECT n_members, count(*) AS n_groups FROM sized GROUP BY 1",
    "p5_found": "WITH " + ", ".join(f"k_{f} AS (SELECT id, language_id, {f}, {_look(f)} AS look FROM lexemes)" for f in ("lemma", "normalized_lemma"))
    + f" {_look_pairs('lemma')} UNION ALL {_look_pairs('normalized_lemma')}",
    "p9_caps": """WITH t AS (SELECT mix_name, source, min({'s': target_share, 'r': max_repeats::BIGINT}) AS t FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY ALL)
SELECT mix_name, source, t.s AS target_share, t.r AS max_repeats, (SELECT count(*) FROM documents d WHERE d.source = t.source AND d.text <> '') AS source_docs, true AS within_repeats FROM t""",
    "p7_found": f"{_OPTION_KEYS} SELECT kept_sense_id, sense_id FROM kept WHERE sense_id <> kept_sense_id",
    "p7_counts": f"{_OPTION_KEYS} SELECT DISTINCT kept_sense_id AS sense_id, n AS duplicate_count FROM kept",
}
