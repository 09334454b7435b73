"""Queries of sense lookup, ranking and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.functions.keys import trimmed
from lexiweave.operators import lookup
from lexiweave.plans.registry import Registry
from lexiweave.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
WORD = ["language_code", "normalized_lemma"]


def star(spark: SparkSession, d: str) -> DataFrame:
    return lookup.star(*(table(spark, d, t) for t in ("senses", "lexemes", "languages", "sense_options")))


_STAR = """WITH star AS (SELECT s.id AS sense_id, s.lexeme_id, s.sense_index, s.source_order, s.definition AS base_definition, s.raw_glosses, s.raw_tags, x.language_id, x.lemma,
  x.normalized_lemma, x.romanization, x.part_of_speech, g.code AS language_code, g.script, g.display_order, coalesce(o.selection_count, 0) AS n_selected, o.pinned_rank, o.definition AS override_definition
  FROM senses s JOIN lexemes x ON s.lexeme_id = x.id JOIN languages g ON x.language_id = g.id LEFT JOIN sense_options o ON o.sense_id = s.id
  WHERE s.visibility_status = 'visible' AND NOT coalesce(o.is_hidden, false))"""
_DICTIONARY = "pinned_rank ASC NULLS LAST, n_selected DESC, source_order ASC NULLS LAST, sense_index ASC NULLS LAST, sense_id"
_HARD, _SOFT = (", ".join(f"'{t}'" for t in ts) for ts in (lookup.HARD_DEMOTE_TAGS, lookup.SOFT_DEMOTE_TAGS))
_SIGNALS = f"""{_STAR}, capped AS (SELECT * FROM star QUALIFY row_number() OVER (PARTITION BY language_code, normalized_lemma ORDER BY {_DICTIONARY}) <= 1000), sig AS (SELECT *, dense_rank() OVER (PARTITION BY language_code, normalized_lemma ORDER BY source_order ASC NULLS LAST, lexeme_id) - 1 AS etymology_rank,
  len(list_distinct(list_filter(coalesce(raw_tags, []), lambda t: t IN ({_HARD})))) AS n_hard, len(list_distinct(list_filter(coalesce(raw_tags, []), lambda t: t IN ({_SOFT})))) AS n_soft,
  greatest(len(list_filter(coalesce(raw_glosses, []), lambda g: trim(g) <> '')) - 1, 0) AS gloss_depth, CASE WHEN n_selected >= 5 THEN n_selected ELSE 0 END AS tier FROM capped),
scored AS (SELECT *, round(-0.10 * ln(1 + greatest(0, coalesce(sense_index, 0) - 1)) - 1.00 * etymology_rank - 0.08 * gloss_depth - 0.25 * n_hard - 0.10 * n_soft, 6) AS score FROM sig)"""
_RANKED = "pinned_rank ASC NULLS LAST, tier DESC, score DESC, source_order ASC NULLS LAST, sense_index ASC NULLS LAST, sense_id"


@R.query(f"""{_STAR}, r AS (SELECT *, row_number() OVER (PARTITION BY language_code, normalized_lemma ORDER BY {_DICTIONARY}) AS rank FROM star)
SELECT language_code, normalized_lemma, sense_id, coalesce(nullif(override_definition, ''), base_definition) AS definition, n_selected, rank FROM r WHERE rank <= 20""", longs=("rank",))
def lookup_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 senses of every word in dictionary order: all lookups at once."""
    top = lookup.top_per_key(star(spark, d), WORD, lookup.dictionary_order(), 20)
    return top.select(*WORD, "sense_id", lookup.effective("override_definition", "base_definition").alias("definition"), "n_selected", "rank")


@R.query(f"""{_SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY language_code, normalized_lemma ORDER BY {_RANKED}) AS rank FROM scored)
SELECT language_code, normalized_lemma, sense_id, etymology_rank, n_hard, n_soft, gloss_depth, tier, score, rank FROM r WHERE rank <= 20""", longs=("etymology_rank", "n_hard", "n_soft", "gloss_depth", "rank"))
def lookup_rank_signals(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 senses of every word by score, with the signals. As in a single lookup, the 1000 first of the dictionary are ranked."""
    capped = lookup.top_per_key(star(spark, d), WORD, lookup.dictionary_order(), lookup.RANKED_SENSES).drop("rank")
    top = lookup.top_per_key(lookup.signals(capped, WORD), WORD, lookup.ranked_order(), 20)
    return top.select(*WORD, "sense_id", "etymology_rank", "n_hard", "n_soft", "gloss_depth", "tier", "score", "rank")


def _first() -> list[Column]:
    return [F.coalesce(c, F.lit(2**31 - 1)) for c in ("source_order", "sense_index")]


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).withColumn("def_key", F.lower(trimmed(F.coalesce("base_definition", F.lit("")))))


@R.query(rf"""{_STAR}, keyed AS (SELECT *, lower(regexp_replace(coalesce(base_definition, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS def_key FROM star)
SELECT language_code, normalized_lemma, def_key, min_by(sense_id, (coalesce(source_order, 2147483647), coalesce(sense_index, 2147483647), sense_id)) AS sense_id, count(*) AS n_rows,
  CAST(sum(sense_id) - min_by(sense_id, (coalesce(source_order, 2147483647), coalesce(sense_index, 2147483647), sense_id)) AS BIGINT) AS absorbed_sum
FROM keyed GROUP BY language_code, normalized_lemma, def_key""")
def lookup_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One sense for each word and definition, whatever its part of speech."""
    return lookup.collapse(_keyed(spark, d), [*WORD, "def_key"], _first(), "sense_id")


@R.query(rf"""{_STAR}, keyed AS (SELECT *, lower(regexp_replace(coalesce(base_definition, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS def_key FROM star),
k AS (SELECT sense_id, first_value(sense_id) OVER (PARTITION BY language_code, normalized_lemma, def_key ORDER BY coalesce(source_order, 2147483647), coalesce(sense_index, 2147483647), sense_id) AS kept_id FROM keyed)
SELECT kept_id, sense_id AS absorbed_id FROM k WHERE kept_id <> sense_id""")
def lookup_absorbed(spark: SparkSession, d: str) -> DataFrame:
    """Which senses stand behind which."""
    keyed = _keyed(spark, d)
    return lookup.absorbed(keyed, [*WORD, "def_key"], lookup.collapse(keyed, [*WORD, "def_key"], _first(), "sense_id"), "sense_id")


@R.query(r"""WITH k AS (SELECT id AS sense_id, list_filter(list_transform(coalesce(raw_glosses, []), lambda g: regexp_replace(g, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda g: g <> '') AS kept FROM senses),
s AS (SELECT sense_id, kept[-1] AS definition, list_filter(kept[1:greatest(len(kept) - 1, 0)], lambda g: NOT (length(regexp_replace(lower(g), '[^\p{L}\p{N}]+', '', 'g')) >= 6
  AND starts_with(regexp_replace(lower(kept[-1]), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(lower(g), '[^\p{L}\p{N}]+', '', 'g')))) AS path FROM k)
SELECT sense_id, definition, array_to_string(path[greatest(len(path) - 2, 1):], ' > ') AS group_path FROM s""")
def display_split(spark: SparkSession, d: str) -> DataFrame:
    """Definition and group path of every sense."""
    definition, path = lookup.display_split(F.col("raw_glosses"))
    return table(spark, d, "senses").select(F.col("id").alias("sense_id"), definition.alias("definition"), path.alias("group_path"))


@R.query("""SELECT s.id AS sense_id, coalesce(nullif(o.definition, ''), s.definition) AS definition, CASE WHEN nullif(o.word, '') IS NOT NULL AND o.word <> x.lemma THEN NULL ELSE x.romanization END AS romanization,
  coalesce(nullif(o.word, ''), x.lemma) AS label FROM senses s JOIN lexemes x ON x.id = s.lexeme_id LEFT JOIN sense_options o ON o.sense_id = s.id""")
def override_project(spark: SparkSession, d: str) -> DataFrame:
    """Overrides before base values; a romanization goes with its own label only."""
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), F.col("definition").alias("base"), "lexeme_id")
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "lemma", "romanization")
    o = table(spark, d, "sense_options").select("sense_id", F.col("definition").alias("over"), "word")
    j = s.join(x, "lexeme_id").join(o, "sense_id", "left")
    other = F.nullif("word", F.lit("")).isNotNull() & (F.col("word") != F.col("lemma"))
    return j.select("sense_id", lookup.effective("over", "base").alias("definition"), F.when(~F.coalesce(other, F.lit(False)), F.col("romanization")).alias("romanization"), lookup.effective("word", "lemma").alias("label"))


@R.query("""SELECT s.id AS sense_id, substr(sha1(concat_ws('|', g.code, x.lemma, x.part_of_speech, CAST(s.sense_index AS VARCHAR), s.definition)), 1, 16) AS locator,
  substr(sha1(concat_ws('|', g.code, x.lemma, x.part_of_speech, s.etymology_text)), 1, 16) AS entry FROM senses s JOIN lexemes x ON x.id = s.lexeme_id JOIN languages g ON g.id = x.language_id""")
def sha1_locator(spark: SparkSession, d: str) -> DataFrame:
    """Stable 16-digit keys of senses and entries."""
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", "sense_index", "definition", "etymology_text")
    j = s.join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "lemma", "part_of_speech"), "lexeme_id").join(
        table(spark, d, "languages").select(F.col("id").alias("language_id"), "code"), "language_id"
    )
    digest = lambda *c: F.substring(F.sha1(F.concat_ws("|", *c)), 1, 16)
    return j.select("sense_id", digest("code", "lemma", "part_of_speech", F.col("sense_index").cast("string"), "definition").alias("locator"), digest("code", "lemma", "part_of_speech", "etymology_text").alias("entry"))


@R.query(f"""{_STAR}, r AS (SELECT *, row_number() OVER (PARTITION BY language_code ORDER BY n_selected DESC, sense_id) AS rank FROM star)
SELECT language_code, display_order, sense_id, n_selected, rank FROM r WHERE rank <= 10""", longs=("rank",))
def directory_order(spark: SparkSession, d: str) -> DataFrame:
    """The most selected senses of each language; the limit comes after the ranking."""
    return lookup.top_per_key(star(spark, d), ["language_code"], [F.desc("n_selected"), F.asc("sense_id")], 10).select("language_code", "display_order", "sense_id", "n_selected", "rank")


@R.query("""SELECT code, name, script IN ('Arab', 'Hebr') AS right_to_left, CAST(row_number() OVER (ORDER BY coalesce(code <> 'en', true), display_order ASC NULLS LAST, id) AS INTEGER) AS position FROM languages g
WHERE EXISTS (SELECT 1 FROM lexemes x JOIN senses s ON s.lexeme_id = x.id WHERE x.language_id = g.id AND s.visibility_status = 'visible')""")
def language_directory(spark: SparkSession, d: str) -> DataFrame:
    """Languages with a visible sense, English first, in display order. The window runs over the language dimension, whose size is fixed."""
    lex = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id")
    seen = table(spark, d, "senses").filter("visibility_status = 'visible'").select("lexeme_id").join(lex, "lexeme_id").select(F.col("language_id").alias("id")).distinct()
    order = Window.orderBy(F.coalesce(F.col("code") != "en", F.lit(True)), F.asc_nulls_last("display_order"), "id")
    return table(spark, d, "languages").join(seen, "id", "left_semi").select("code", "name", F.col("script").isin("Arab", "Hebr").alias("right_to_left"), F.row_number().over(order).alias("position"))


@R.query(f"""{_STAR}, t AS (SELECT *, n_selected > 0 AS clicked FROM star)
SELECT sense_id, CASE WHEN clicked THEN 'exact' ELSE 'expanded' END AS match_type, script IN ('Arab', 'Hebr') AS right_to_left, lemma AS word,
  'Sense ' || CAST(sense_id AS VARCHAR) || ' of ' || coalesce(lemma, '?') || ' (' || coalesce(part_of_speech, '?') || '), selected ' || CAST(n_selected AS VARCHAR) || ' times' AS explanation FROM t""")
def response_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape in which a sense is served, with its explanation."""
    said = F.concat(F.lit("Sense "), F.col("sense_id").cast("string"), F.lit(" of "), F.coalesce("lemma", F.lit("?")), F.lit(" ("), F.coalesce("part_of_speech", F.lit("?")), F.lit("), selected "), F.col("n_selected").cast("string"), F.lit(" times"))
    kind = F.when(F.col("n_selected") > 0, "exact").otherwise("expanded")
    return star(spark, d).select("sense_id", kind.alias("match_type"), F.col("script").isin("Arab", "Hebr").alias("right_to_left"), F.col("lemma").alias("word"), said.alias("explanation"))


@R.query("""WITH c AS (SELECT id, slug, label, description, external_source_slug FROM concepts)
SELECT id, regexp_replace(lower(trim(coalesce(label, ''))), '[^\\p{L}\\p{N}]+', '_', 'g') AS label_slug, left(description, 120) AS short_text, lower(trim(split_part(label, '/', 1))) AS group_key,
  split_part(coalesce(external_source_slug, 'none'), '-', 1) AS provenance, concat_ws('; ', label || ': ' || coalesce(description, ''), 'from ' || external_source_slug) AS embedding_text FROM c""")
def text_project(spark: SparkSession, d: str) -> DataFrame:
    """Derived texts of concepts: slug, short text, group key, provenance, text to embed."""
    c = table(spark, d, "concepts")
    return c.select(
        "id",
        F.regexp_replace(F.lower(F.trim(F.coalesce("label", F.lit("")))), r"[^\p{L}\p{N}]+", "_").alias("label_slug"),
        F.left("description", F.lit(120)).alias("short_text"),
        F.lower(F.trim(F.split_part("label", F.lit("/"), F.lit(1)))).alias("group_key"),
        F.split_part(F.coalesce("external_source_slug", F.lit("none")), F.lit("-"), F.lit(1)).alias("provenance"),
        F.concat_ws("; ", F.concat("label", F.lit(": "), F.coalesce("description", F.lit(""))), F.concat(F.lit("from "), "external_source_slug")).alias("embedding_text"),
    )


@R.query("""WITH r AS (SELECT language_id, id, lemma, length(regexp_replace(lemma, '[-\\s'']', '', 'g')) AS n_letters FROM lexemes WHERE lemma IS NOT NULL)
SELECT language_id, id, n_letters, row_number() OVER (PARTITION BY language_id ORDER BY n_letters, lemma, id) AS place FROM r WHERE n_letters BETWEEN 4 AND 12 QUALIFY place <= 50""", longs=("n_letters", "place"))
def client_sort(spark: SparkSession, d: str) -> DataFrame:
    """The shortest words of each language, separators not counted."""
    n = F.length(F.regexp_replace("lemma", r"[-\s']", ""))
    rows = table(spark, d, "lexemes").select("language_id", "id", "lemma", n.alias("n_letters")).filter("n_letters BETWEEN 4 AND 12")
    return lookup.top_per_key(rows, ["language_id"], [F.asc("n_letters"), F.asc("lemma"), F.asc("id")], 50, "place").select("language_id", "id", "n_letters", "place")


@R.query(f"""{_STAR}, r AS (SELECT language_code, normalized_lemma, part_of_speech, row_number() OVER (PARTITION BY language_code, normalized_lemma ORDER BY {_DICTIONARY}) AS rank FROM star QUALIFY rank <= 20),
c AS (SELECT *, CASE WHEN lag(part_of_speech) OVER (PARTITION BY language_code, normalized_lemma ORDER BY rank) IS DISTINCT FROM part_of_speech OR rank = 1 THEN 1 ELSE 0 END AS starts FROM r)
SELECT language_code, normalized_lemma, rank, sum(starts) OVER (PARTITION BY language_code, normalized_lemma ORDER BY rank)::BIGINT AS run FROM c""", longs=("rank",))
def run_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal part of speech in a word's first 20 senses."""
    top = lookup.top_per_key(star(spark, d), WORD, lookup.dictionary_order(), 20).select(*WORD, "part_of_speech", "rank")
    w = Window.partitionBy(*WORD).orderBy("rank")
    starts = F.when(~F.lag("part_of_speech").over(w).eqNullSafe(F.col("part_of_speech")) | (F.col("rank") == 1), 1).otherwise(0)
    return top.withColumn("starts", starts).select(*WORD, "rank", F.sum("starts").over(w).alias("run"))
