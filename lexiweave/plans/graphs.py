"""Queries of links between words and concepts, trees and roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.functions import fixed
from lexiweave.functions.keys import slug_key, trimmed
from lexiweave.operators import edges, expansion, vectors
from lexiweave.operators import roots as roots_of
from lexiweave.operators.lookup import top_per_key
from lexiweave.operators.vectors import cosine
from lexiweave.plans.registry import Registry
from lexiweave.session import table
from lexiweave.skew import hot_keys, salted_join

R = Registry()
QUERIES, SQL = R.queries, R.sql
EVERY = 100


def _slug(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


# ---- words, lexemes and synsets


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_entries").select("row_id", "synset_id", "language_code", F.lower("lemma").alias("word"), "part_of_speech").filter("word IS NOT NULL AND synset_id IS NOT NULL")


_ENTRIES = "entries AS (SELECT row_id, synset_id, language_code, lower(lemma) AS word, part_of_speech FROM raw_entries WHERE lemma IS NOT NULL AND synset_id IS NOT NULL)"


@R.query(f"""WITH {_ENTRIES} SELECT q.word, r.word AS other, count(DISTINCT q.synset_id) AS n_shared FROM entries q JOIN entries r ON q.synset_id = r.synset_id AND q.word <> r.word WHERE q.row_id % {EVERY} = 0 GROUP BY ALL""")
def shared_ili(spark: SparkSession, d: str) -> DataFrame:
    """Synsets that the words of every hundredth entry share with other words."""
    e = entries(spark, d)
    return edges.shared_keys(e.filter(F.col("row_id") % EVERY == 0), e, "word", "synset_id", e.count())


@R.query(f"WITH {_ENTRIES}, h AS (SELECT synset_id, min(word) AS hub FROM entries GROUP BY 1) SELECT DISTINCT e.synset_id, h.hub, e.word FROM entries e JOIN h USING (synset_id) WHERE e.word <> h.hub")
def comembership_edges(spark: SparkSession, d: str) -> DataFrame:
    """Words of one synset, each linked to the synset's first."""
    e = entries(spark, d)
    return edges.comembers(e, "synset_id", "word", e.count())


@R.query(f"""WITH e AS (SELECT {_slug('source_concept_slug')} AS a, {_slug('target_concept_slug')} AS b FROM concept_relationships WHERE {_slug('relationship_type')} = 'near_synonym')
SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b""")
def similar_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """Near synonyms in both directions."""
    e = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "near_synonym").select(slug_key("source_concept_slug").alias("a"), slug_key("target_concept_slug").alias("b"))
    return edges.symmetric(e, "a", "b")


_SENSES = "ls AS (SELECT s.id AS sense_id, s.sense_index, s.visibility_status, x.id AS lexeme_id, x.language_id, x.normalized_lemma, x.part_of_speech FROM senses s JOIN lexemes x ON x.id = s.lexeme_id)"


def lexeme_senses(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", "sense_index", "visibility_status")
    return s.join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "normalized_lemma", "part_of_speech"), "lexeme_id")


@R.query(f"WITH {_SENSES} SELECT language_id, normalized_lemma, part_of_speech, min_by(sense_id, (coalesce(sense_index, 2147483647), sense_id)) AS sense_id FROM ls GROUP BY language_id, normalized_lemma, part_of_speech")
def primary_sense(spark: SparkSession, d: str) -> DataFrame:
    """The first sense of each word and part of speech."""
    return edges.primary_senses(lexeme_senses(spark, d), ["language_id", "normalized_lemma", "part_of_speech"])


@R.query(f"""WITH {_SENSES}, p AS (SELECT language_id, normalized_lemma AS word, part_of_speech, min_by(sense_id, (coalesce(sense_index, 2147483647), sense_id)) AS sense_id FROM ls GROUP BY 1, 2, 3)
SELECT DISTINCT w.external_synset_id AS synset_id, p.sense_id FROM word_senses w JOIN languages g ON g.code = w.language_code JOIN p ON p.language_id = g.id AND p.word = lower(w.word_text) AND p.part_of_speech = w.part_of_speech WHERE w.external_synset_id IS NOT NULL""")
def wordnet_import(spark: SparkSession, d: str) -> DataFrame:
    """Synset members attached to the primary sense of their word and part of speech, each membership once."""
    primary = edges.primary_senses(lexeme_senses(spark, d), ["language_id", "normalized_lemma", "part_of_speech"]).withColumnRenamed("normalized_lemma", "word")
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("code").alias("language_code"))
    w = table(spark, d, "word_senses").filter("external_synset_id IS NOT NULL").select(F.col("external_synset_id").alias("synset_id"), "language_code", F.lower("word_text").alias("word"), "part_of_speech")
    return w.join(g, "language_code").join(primary, ["language_id", "word", "part_of_speech"]).select("synset_id", "sense_id").distinct()


@R.query("""WITH g AS (SELECT lexeme_id, unnest(raw_glosses) AS gloss, generate_subscripts(raw_glosses, 1) - 1 AS pos FROM senses WHERE sense_index = 0)
SELECT g.lexeme_id, g.pos, s.id AS sense_id FROM g JOIN senses s ON s.lexeme_id = g.lexeme_id AND s.sense_index = g.pos""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Elements of an array joined to the rows their positions name."""
    s = table(spark, d, "senses")
    g = s.filter("sense_index = 0").select("lexeme_id", F.posexplode("raw_glosses").alias("pos", "gloss"))
    return g.join(s.select("lexeme_id", F.col("sense_index").alias("pos"), F.col("id").alias("sense_id")), ["lexeme_id", "pos"]).select("lexeme_id", F.col("pos").cast("long").alias("pos"), "sense_id")


@R.query(f"""WITH q AS (SELECT id, language_id, normalized_lemma FROM lexemes WHERE id % {EVERY} = 0)
SELECT q.id AS query_id, x.id AS lexeme_id, q.id = x.id AS is_original FROM q JOIN lexemes x ON x.language_id = q.language_id AND x.normalized_lemma = q.normalized_lemma""")
def homograph_widen(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth lexeme with its homographs."""
    x = table(spark, d, "lexemes").select("id", F.struct("language_id", "normalized_lemma").alias("k")).filter("k.language_id IS NOT NULL AND k.normalized_lemma IS NOT NULL")
    q = x.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "k")
    j = salted_join(x, q, "k", hot_keys(x, "k", x.count()), "id")
    return j.select("query_id", F.col("id").alias("lexeme_id"), (F.col("query_id") == F.col("id")).alias("is_original"))


# ---- relations inside the raw records

_WORDS = "array<struct<word string, code string, sense string, _dis1 string>>"


def _nested(spark: SparkSession, d: str, key: str) -> DataFrame:
    """(sense_id, pos, word, code, sense, _dis1) of one array of a raw sense; records that keep one object give one row."""
    raw = F.get_json_object("raw_sense", f"$.{key}")
    listed = F.when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    rows = table(spark, d, "senses").filter("raw_sense IS NOT NULL").select(F.col("id").alias("sense_id"), "lexeme_id", F.posexplode(F.from_json(listed, _WORDS)).alias("pos", "o"))
    return rows.select("sense_id", "lexeme_id", F.col("pos").cast("long").alias("pos"), "o.*").filter("word IS NOT NULL")


def _nested_sql(key: str) -> str:
    return f"""SELECT id AS sense_id, lexeme_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, lexeme_id, CAST(CASE WHEN json_type(raw_sense, '$.{key}') = 'ARRAY' THEN raw_sense -> '{key}' ELSE json_array(raw_sense -> '{key}') END AS JSON[]) AS l
    FROM senses WHERE json_type(raw_sense) = 'OBJECT' AND json_type(raw_sense, '$.{key}') IN ('ARRAY', 'OBJECT'))"""


@R.query(f"""WITH n AS ({_nested_sql('synonyms')}), w AS (SELECT sense_id, pos, o ->> 'word' AS word, list_transform(string_split(o ->> '_dis1', ' '), lambda x: CAST(x AS INTEGER)) AS ws FROM n WHERE o ->> 'word' IS NOT NULL AND o ->> '_dis1' IS NOT NULL)
SELECT sense_id, pos, word, CAST(list_position(ws, list_max(ws)) AS INTEGER) AS first_best, list_filter(list_transform(ws, lambda x, i: CASE WHEN x >= 0.6 * list_max(ws) THEN i END), lambda x: x IS NOT NULL) AS kept FROM w""")
def dis1_route(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a relation by its weights for the entry's senses."""
    n = _nested(spark, d, "synonyms").filter("_dis1 IS NOT NULL")
    best, kept = edges.routed(F.transform(F.split("_dis1", " "), lambda x: x.cast("int")))
    return n.select("sense_id", "pos", "word", best.alias("first_best"), kept.cast("array<bigint>").alias("kept"))


@R.query(f"""WITH n AS ({_nested_sql('synonyms')}), r AS (SELECT sense_id, lexeme_id, o ->> 'word' AS word, list_transform(string_split(o ->> '_dis1', ' '), lambda x: CAST(x AS INTEGER)) AS ws FROM n WHERE o ->> 'word' IS NOT NULL),
exact AS (SELECT sense_id, lower(word) AS target, 0 AS route FROM r WHERE ws IS NULL),
sent AS (SELECT s.id AS sense_id, lower(r.word) AS target, 1 AS route FROM (SELECT *, unnest(list_filter(list_transform(ws, lambda x, i: CASE WHEN x >= 0.6 * list_max(ws) THEN i END), lambda x: x IS NOT NULL)) AS place FROM r WHERE ws IS NOT NULL) r JOIN senses s ON s.lexeme_id = r.lexeme_id AND s.sense_index + 1 = r.place)
SELECT sense_id, target, min(route) AS route FROM (SELECT * FROM exact UNION ALL SELECT * FROM sent) GROUP BY sense_id, target""")
def relation_route(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms at their sense, or sent to senses of the entry by weight; each edge once, the exact route first."""
    n = _nested(spark, d, "synonyms")
    exact = n.filter("_dis1 IS NULL").select("sense_id", F.lower("word").alias("target"), F.lit(0).alias("route"))
    _, kept = edges.routed(F.transform(F.split("_dis1", " "), lambda x: x.cast("int")))
    sent = n.filter("_dis1 IS NOT NULL").select("lexeme_id", F.lower("word").alias("target"), F.explode(kept).alias("place"))
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", (F.col("sense_index") + 1).alias("place"))
    sent = sent.join(s, ["lexeme_id", "place"]).select("sense_id", "target", F.lit(1).alias("route"))
    return exact.unionByName(sent).groupBy("sense_id", "target").agg(F.min("route").alias("route"))


@R.query(f"""WITH n AS ({_nested_sql('translations')}), t AS (SELECT n.sense_id, g.id AS language_id, lower({_trim("o ->> 'word'")}) AS target, n.pos FROM n JOIN languages g ON g.code = o ->> 'code' JOIN senses s ON s.id = n.sense_id AND s.visibility_status = 'visible' WHERE o ->> 'word' IS NOT NULL)
SELECT sense_id, language_id, target, min(pos) AS pos FROM t WHERE target <> '' GROUP BY sense_id, language_id, target""")
def translation_route(spark: SparkSession, d: str) -> DataFrame:
    """Translations of visible senses into known languages; the first of a target wins."""
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), "code")
    seen = table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("id").alias("sense_id"))
    t = _nested(spark, d, "translations").join(g, "code").join(seen, "sense_id", "left_semi").withColumn("target", F.lower(trimmed("word"))).filter("target <> ''")
    return t.groupBy("sense_id", "language_id", "target").agg(F.min("pos").alias("pos"))


@R.query(f"""WITH n AS ({_nested_sql('synonyms')}), a AS (SELECT sense_id, lower(o ->> 'word') AS syn FROM n), n2 AS ({_nested_sql('related')}), b AS (SELECT sense_id, lower(o ->> 'word') AS syn FROM n2),
u AS (SELECT sense_id, syn, min(p) AS priority FROM (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b) WHERE syn IS NOT NULL AND NOT contains(syn, ' ') GROUP BY 1, 2)
SELECT sense_id, syn, priority, row_number() OVER (PARTITION BY sense_id ORDER BY priority, syn) AS place FROM u JOIN (SELECT s.id, lower(x.lemma) AS lemma FROM senses s JOIN lexemes x ON x.id = s.lexeme_id) l ON l.id = u.sense_id WHERE syn IS DISTINCT FROM l.lemma QUALIFY place <= 10""", longs=("place",))
def synonym_union(spark: SparkSession, d: str) -> DataFrame:
    """Up to 10 single words for each sense from two sources in order, without its own lemma."""
    own = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id").join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), F.lower("lemma").alias("lemma")), "lexeme_id").drop("lexeme_id")
    parts = [_nested(spark, d, k).select("sense_id", F.lower("word").alias("syn")).filter("NOT contains(syn, ' ')").join(own, "sense_id").filter("NOT syn <=> lemma") for k in ("synonyms", "related")]
    return edges.priority_union(parts, ["sense_id"], "syn", 10)


@R.query(f"""WITH n AS ({_nested_sql('form_of')}), r AS (SELECT n.sense_id, o ->> 'word' AS word, x.language_id, x.part_of_speech FROM n JOIN lexemes x ON x.id = n.lexeme_id WHERE o ->> 'word' IS NOT NULL),
t AS (SELECT r.*, (SELECT min(id) FROM lexemes l WHERE l.lemma = r.word AND l.language_id = r.language_id AND l.part_of_speech = r.part_of_speech) AS own, (SELECT min(id) FROM lexemes l WHERE l.lemma = r.word AND l.language_id = r.language_id) AS other FROM r)
SELECT sense_id, word, coalesce(own, other) AS target_id, CASE WHEN own IS NOT NULL THEN 'own' WHEN other IS NOT NULL THEN 'other' ELSE 'unresolved' END AS found_in FROM t""")
def variant_edges(spark: SparkSession, d: str) -> DataFrame:
    """Forms resolved to lexemes of their own part of speech first, then of any."""
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "part_of_speech", "lemma")
    r = _nested(spark, d, "form_of").select("sense_id", "lexeme_id", "word").join(x.drop("lemma"), "lexeme_id")
    own = x.select(F.struct("lemma", "language_id", "part_of_speech").alias("k"), F.col("lexeme_id").alias("target_id")).filter("k.part_of_speech IS NOT NULL")
    other = x.select(F.struct("lemma", "language_id").alias("k"), F.col("lexeme_id").alias("target_id"))
    n = r.count()
    first = edges.resolve(r.withColumn("k", F.struct(F.col("word").alias("lemma"), "language_id", "part_of_speech")), "k", [("own", own)], n).drop("k")
    left = first.filter("found_in = 'unresolved'").drop("target_id", "found_in").withColumn("k", F.struct(F.col("word").alias("lemma"), "language_id"))
    second = edges.resolve(left, "k", [("other", other)], n).drop("k")
    return first.filter("found_in <> 'unresolved'").unionByName(second).select("sense_id", "word", "target_id", "found_in")


# ---- joins between tables


@R.query(f"""WITH c AS (SELECT DISTINCT {_slug('slug')} AS slug FROM concepts)
SELECT w.language_code, count(*) AS n_rows, count(*) FILTER (WHERE c.slug IS NULL) AS n_missing FROM word_senses w LEFT JOIN c ON c.slug = {_slug('w.concept_slug')} GROUP BY w.language_code""")
def dimension_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Word senses whose concept is in no catalogue, by language. References are counted by key before they meet the catalogue."""
    w = table(spark, d, "word_senses").groupBy("language_code", slug_key("concept_slug").alias("slug")).agg(F.count("*").alias("n"))
    c = table(spark, d, "concepts").select(slug_key("slug").alias("slug")).distinct().withColumn("there", F.lit(True))
    return w.join(c, "slug", "left").groupBy("language_code").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("there").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))


@R.query(f"""WITH k AS (SELECT DISTINCT {_slug('concept_slug')} AS slug, language_code FROM word_senses WHERE {_slug('concept_slug')} IS NOT NULL AND language_code IS NOT NULL)
SELECT a.language_code AS language_a, b.language_code AS language_b, count(*) AS n_shared FROM k a JOIN k b ON a.slug = b.slug AND a.language_code < b.language_code GROUP BY ALL""")
def cross_group_self(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that two languages share. Rows are reduced to one a concept and language first, so a concept meets itself over languages, not rows."""
    k = table(spark, d, "word_senses").select(slug_key("concept_slug").alias("slug"), "language_code").dropna().distinct()
    a, b = k.alias("a"), k.alias("b")
    j = a.join(b, F.expr("a.slug = b.slug AND a.language_code < b.language_code"))
    return j.groupBy(F.col("a.language_code").alias("language_a"), F.col("b.language_code").alias("language_b")).agg(F.count("*").alias("n_shared"))


@R.query("""SELECT g.code, count(*) AS n_lexemes FROM lexemes x JOIN languages g ON g.id = x.language_id WHERE EXISTS (SELECT 1 FROM senses s WHERE s.lexeme_id = x.id AND s.visibility_status = 'visible') GROUP BY g.code""")
def semi_visible(spark: SparkSession, d: str) -> DataFrame:
    """Lexemes with a visible sense, by language."""
    x = table(spark, d, "lexemes").join(table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("lexeme_id").alias("id")), "id", "left_semi")
    return x.join(table(spark, d, "languages").select(F.col("id").alias("language_id"), "code"), "language_id").groupBy("code").agg(F.count("*").alias("n_lexemes"))


@R.query("SELECT x.id AS lexeme_id, x.language_id FROM lexemes x WHERE NOT EXISTS (SELECT 1 FROM senses s WHERE s.lexeme_id = x.id)")
def orphan_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Lexemes without any sense."""
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id")
    return x.join(table(spark, d, "senses").select("lexeme_id"), "lexeme_id", "left_anti")


@R.query(f"""WITH n AS ({_nested_sql('translations')}) SELECT s.id AS sense_id, coalesce(o.selection_count, 0) AS n_selected, CAST(row_number() OVER (PARTITION BY s.source_id ORDER BY coalesce(o.selection_count, 0) > 0 DESC, coalesce(o.selection_count, 0) DESC, s.id) AS INTEGER) AS place
FROM senses s LEFT JOIN sense_options o ON o.sense_id = s.id WHERE s.visibility_status = 'visible' AND NOT EXISTS (SELECT 1 FROM n WHERE n.sense_id = s.id) AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = s.id)
AND NOT EXISTS (SELECT 1 FROM lexemes x WHERE x.id = s.lexeme_id AND x.import_status <> 'active') QUALIFY place <= 100""")
def thin_population(spark: SparkSession, d: str) -> DataFrame:
    """Senses with neither translation nor vector, of words whose import is active, the most wanted 100 of each source first: a top-k report."""
    s = table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("id").alias("sense_id"), "source_id", "lexeme_id")
    retired = table(spark, d, "lexemes").filter("import_status <> 'active'").select(F.col("id").alias("lexeme_id"))
    vectored = table(spark, d, "embeddings").select(F.col("vec_id").alias("sense_id"))
    s = s.join(_nested(spark, d, "translations").select("sense_id"), "sense_id", "left_anti").join(vectored, "sense_id", "left_anti").join(retired, "lexeme_id", "left_anti")
    s = s.join(table(spark, d, "sense_options").select("sense_id", "selection_count"), "sense_id", "left").withColumn("n_selected", F.coalesce("selection_count", F.lit(0)))
    return top_per_key(s, ["source_id"], [F.desc(F.col("n_selected") > 0), F.desc("n_selected"), F.asc("sense_id")], 100, "place").select("sense_id", "n_selected", "place")


@R.query(f"""WITH q AS (SELECT id, language_code, {_slug('concept_slug')} AS slug, word_text FROM word_senses WHERE id % {EVERY} = 0 AND language_code = 'en'),
b AS (SELECT {_slug('concept_slug')} AS slug, language_code, word_text, min(id) AS id FROM word_senses WHERE is_primary AND language_code IN ('de', 'es') GROUP BY ALL),
f AS (SELECT slug, language_code, min_by(word_text, id) AS bridge FROM b WHERE word_text IS NOT NULL GROUP BY ALL),
e AS (SELECT {_slug('concept_slug')} AS slug, min_by(word_text, id) AS back FROM word_senses WHERE language_code = 'en' AND word_text IS NOT NULL GROUP BY ALL)
SELECT q.id, f.language_code, f.bridge, e.back FROM q JOIN f ON f.slug = q.slug JOIN e ON e.slug = f.slug""")
def pivot_bridge(spark: SparkSession, d: str) -> DataFrame:
    """English words to other languages and back over their concept; one bridge word a concept and language, chosen before the join."""
    w = table(spark, d, "word_senses").select("id", "language_code", slug_key("concept_slug").alias("slug"), "word_text", "is_primary")
    bridge = edges.first_row(w.filter("is_primary AND language_code IN ('de', 'es') AND word_text IS NOT NULL AND slug IS NOT NULL"), ["slug", "language_code"], [F.col("id")], "word_text").withColumnRenamed("word_text", "bridge")
    back = edges.first_row(w.filter("language_code = 'en' AND word_text IS NOT NULL AND slug IS NOT NULL"), ["slug"], [F.col("id")], "word_text").withColumnRenamed("word_text", "back")
    q = w.filter((F.col("id") % EVERY == 0) & (F.col("language_code") == "en")).select("id", "slug")
    return q.join(bridge, "slug").join(back, "slug").select("id", "language_code", "bridge", "back")


@R.query(f"""SELECT DISTINCT {_slug('c.slug')} AS slug, c.domain FROM concepts c WHERE EXISTS (SELECT 1 FROM word_senses w WHERE {_slug('w.concept_slug')} = {_slug('c.slug')} AND w.language_code = 'la') AND EXISTS (
  SELECT 1 FROM concept_relationships r WHERE {_slug('r.source_concept_slug')} = {_slug('c.slug')} AND {_slug('r.relationship_type')} = 'symbolic')""")
def bridge_filter(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with a Latin word and a symbolic relation: two bridges, each parent once."""
    c = table(spark, d, "concepts").select(slug_key("slug").alias("slug"), "domain")
    w = table(spark, d, "word_senses").filter("language_code = 'la'").select(slug_key("concept_slug").alias("slug"))
    r = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "symbolic").select(slug_key("source_concept_slug").alias("slug"))
    return c.join(w, "slug", "left_semi").join(r, "slug", "left_semi").distinct()


@R.query(rf"""WITH n AS (SELECT DISTINCT s.id AS sense_id, x.language_id, unnest(regexp_extract_all(lower(s.definition), '\p{{L}}{{4,}}')) AS t FROM senses s JOIN lexemes x ON x.id = s.lexeme_id WHERE x.part_of_speech = 'name'),
c AS (SELECT DISTINCT s.id AS other_id, x.language_id, unnest(regexp_extract_all(lower(s.definition), '\p{{L}}{{4,}}')) AS t FROM senses s JOIN lexemes x ON x.id = s.lexeme_id WHERE x.part_of_speech <> 'name'),
j AS (SELECT n.sense_id, c.other_id, count(*) AS n_shared FROM n JOIN c USING (language_id, t) GROUP BY ALL) SELECT sense_id, other_id, n_shared FROM j QUALIFY row_number() OVER (PARTITION BY sense_id ORDER BY n_shared DESC, other_id) = 1""")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    """For every name the sense of its language, not a name's, that shares most words with its definition."""
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", F.regexp_extract_all(F.lower("definition"), F.lit(r"\p{L}{4,}"), F.lit(0)).alias("t"))
    j = s.join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "part_of_speech"), "lexeme_id")
    left = j.filter("part_of_speech = 'name'").select("language_id", "sense_id", "t")
    right = j.filter("part_of_speech <> 'name'").select("language_id", F.col("sense_id").alias("other_id"), F.col("t").alias("u"))
    return edges.best_overlap(left, right, "language_id", "sense_id", "other_id", "t", "u")


# ---- trees over concepts

_TIERS = (("synonym", 0), ("near_synonym", 1), ("associated", 2))


def concept_edges(spark: SparkSession, d: str, types: tuple[str, ...] = tuple(t for t, _ in _TIERS)) -> DataFrame:
    kind = slug_key("relationship_type")
    tier = F.coalesce(*[F.when(kind == t, n) for t, n in _TIERS])
    e = table(spark, d, "concept_relationships").filter(kind.isin(*types)).select(
        slug_key("source_concept_slug").alias("src"), slug_key("target_concept_slug").alias("dst"), tier.alias("tier"), F.coalesce("weight", F.lit(0.0)).alias("score"), F.col("id").alias("seq")
    )
    return e.filter("src IS NOT NULL AND dst IS NOT NULL")


def concept_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, node, vector): a concept's vector is that of its earliest row."""
    c = table(spark, d, "concepts").select("id", slug_key("slug").alias("node")).filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    return c.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id").select("id", "node", "vector")


def _nearest_concepts(v: DataFrame, most: int, need: int, scratch: Scratch) -> DataFrame:
    """(src, dst, sim, at): of the ``most`` concepts nearest to each, those above the floor that are no forms of its slug, ``need`` of them at least where there are so many.

    A children's list leaves out at most half of ``need``. Four times ``need``
    are looked at first; a concept for which they do not suffice is searched
    again with ``most``.
    """
    floor = round(fixed.KNN_FLOOR - 0.7, 6)
    name = lambda i, n: v.select(F.col("id").alias(i), F.col("node").alias(n))

    def ranked(queries: DataFrame, k: int) -> DataFrame:
        found = vectors.nearest(queries.select("id", "vector"), v.select("id", "vector"), k).join(name("query_id", "src"), "query_id").join(name("row_id", "dst"), "row_id")
        found = top_per_key(found, ["src"], [F.desc("sim"), F.asc("row_id")], k, "at")
        return found.withColumn("ok", (F.col("sim") >= floor) & ~vectors.same_stem(F.col("src"), F.col("dst"))).select("src", "dst", "sim", "at", "ok")

    few = min(most, 4 * need)
    found = scratch.write(ranked(v, few), "nearest")
    if few < most:
        per = found.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("last"), F.count_if("ok").alias("n_ok"))
        again = scratch.write(per.filter((F.col("n") >= few) & (F.col("last") >= floor) & (F.col("n_ok") < need)).select(F.col("src").alias("node")), "again")
        if not again.isEmpty():
            more = ranked(v.join(again, "node", "left_semi"), most)
            found = found.join(again.withColumnRenamed("node", "src"), "src", "left_anti").unionByName(more)
    return found.filter("ok").drop("ok")


def concept_children(spark: SparkSession, d: str, *choices: tuple[int, tuple[str, ...]]) -> list[DataFrame]:
    """For each (k, types) the k best children of every concept: edges of the types by likeness, then what is nearest by vector.

    As many neighbours are looked at as for words in English; those below the
    floor and forms of the concept's own slug do not count. The floor lies 0.7
    lower here, as the vectors of the data are random.
    """
    scratch, v = Scratch(spark, "children"), concept_vectors(spark, d)
    v = scratch.write(v, "vectors")
    most = max(vectors.fetched(expansion.collected(k) + 1, "en") for k, _ in choices)
    found = scratch.write(_nearest_concepts(v, most, 2 * max(expansion.collected(k) for k, _ in choices), scratch), "near")
    n = table(spark, d, "concept_relationships").count()
    near = lambda k: found.filter(F.col("at") <= vectors.fetched(expansion.collected(k) + 1, "en"))
    every = concept_edges(spark, d, tuple({t: 0 for _, types in choices for t in types}))
    e = scratch.write(expansion.likened(every, v, n), "edges")  # its plan is large, and once is enough
    tiers = dict(_TIERS)
    return [scratch.write(expansion.children(e.filter(F.col("tier").isin([tiers[t] for t in types])), k, near=near(k)), f"children{i}") for i, (k, types) in enumerate(choices)]


def concept_roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").filter(F.col("id") % EVERY == 0).select(slug_key("slug").alias("node")).filter("node IS NOT NULL").distinct()


def _family(a: str, b: str) -> str:
    n = f"greatest(4, CAST(ceil(least(length({a}), length({b})) * 0.6) AS INTEGER))"
    return f"least(length({a}), length({b})) >= {n} AND left({a}, {n}) = left({b}, {n})"


def _kids(name: str, k: int, types: str, weighted: bool = False) -> str:
    """The k best targets of each concept: all of them ranked by score, and filled up with the nearest concepts unless ``weighted`` takes the stored weights alone."""
    c, scored = expansion.collected(k), "o.weight" if weighted else "greatest(0.0, coalesce(list_cosine_similarity(a.vector, b.vector), 0.0))"
    fill = f"""SELECT * FROM {name}_k""" if weighted else f"""SELECT * FROM {name}_k UNION ALL SELECT src, dst, score FROM (SELECT n.src, n.dst, n.sim AS score, row_number() OVER (PARTITION BY n.src ORDER BY n.sim DESC, n.dst) AS p,
    (SELECT count(*) FROM {name}_k h WHERE h.src = n.src) AS have FROM near n WHERE n.spot <= {min(max(50 * (c + 1), 100), 1000)} AND NOT EXISTS (SELECT 1 FROM {name}_k h WHERE h.src = n.src AND h.dst = n.dst)) WHERE p <= {c} - have"""
    return f"""{name}_e AS (SELECT {_slug('source_concept_slug')} AS src, {_slug('target_concept_slug')} AS dst, CASE {_slug('relationship_type')} WHEN 'synonym' THEN 0 WHEN 'near_synonym' THEN 1 ELSE 2 END AS tier, coalesce(weight, 0.0) AS weight, id AS seq FROM concept_relationships WHERE {_slug('relationship_type')} IN ({types})),
{name}_o AS (SELECT * FROM {name}_e WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY tier, seq, weight DESC) = 1),
{name}_k AS (SELECT src, dst, score FROM (SELECT o.src, o.dst, o.tier, o.seq, round({scored}, 6) AS score FROM {name}_o o LEFT JOIN cvec a ON a.node = o.src LEFT JOIN cvec b ON b.node = o.dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, tier, seq, dst) <= {c}),
{name}_f AS ({fill}),
{name}_s AS (SELECT a.src, a.dst, round(a.score - 0.03 * (SELECT count(*) FROM {name}_f b WHERE b.src = a.src AND (b.score > a.score OR (b.score = a.score AND b.dst < a.dst)) AND {_family('a.dst', 'b.dst')}), 6) AS score FROM {name}_f a),
{name} AS (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM {name}_s QUALIFY place <= {k})"""


def _stem(c: str) -> str:
    cases = " ".join(f"WHEN {c} LIKE '%{x}' AND length({c}) > {len(x) + 2} THEN left({c}, length({c}) - {len(x)})" for x in ("ing", "edly", "ed", "es", "s", "er", "est", "ly", "ness", "ment", "tion", "ion"))
    return f"CASE {cases} ELSE {c} END"


def same_stem_sql(a: str, b: str) -> str:
    """Whether two words are forms of one, as vectors.same_stem has it."""
    x, y = _stem(a), _stem(b)
    n = f"greatest(5, least(length({x}), length({y})) - 1)"
    return f"({a} = {b} OR {x} = {y} OR (least(length({x}), length({y})) >= 5 AND left({x}, {n}) = left({y}, {n})))"


_ALL = "'synonym', 'near_synonym', 'associated'"
_ROOTS = f"roots AS (SELECT DISTINCT {_slug('slug')} AS node FROM concepts WHERE id % {EVERY} = 0 AND {_slug('slug')} IS NOT NULL)"
_CVEC = f"cvec AS (SELECT c.node, c.id, CAST(e.embedding AS DOUBLE[]) AS vector FROM (SELECT {_slug('slug')} AS node, min(id) AS id FROM concepts WHERE {_slug('slug')} IS NOT NULL GROUP BY 1) c JOIN embeddings e ON e.vec_id = c.id)"


_NEAR = f"""near AS (SELECT src, dst, sim, spot FROM (SELECT a.node AS src, b.node AS dst, round(list_cosine_similarity(a.vector, b.vector), 6) + 0.0 AS sim, row_number() OVER (PARTITION BY a.node ORDER BY round(list_cosine_similarity(a.vector, b.vector), 6) DESC, b.id) AS spot
  FROM cvec a JOIN cvec b ON a.id <> b.id) WHERE sim >= {round(fixed.KNN_FLOOR - 0.7, 6)} AND NOT {same_stem_sql('src', 'dst')})"""


@R.query(f"WITH {_CVEC}, {_NEAR}, {_kids('kids', 5, _ALL)} SELECT src, dst, score, place FROM kids", longs=("place",))
def expand_single(spark: SparkSession, d: str) -> DataFrame:
    """The five best targets of every concept by likeness, filled up with what is nearest, with the penalty for families."""
    return concept_children(spark, d, (5, tuple(t for t, _ in _TIERS)))[0]


def _level(n: int, kids: str) -> str:
    seen = " UNION ALL ".join(f"SELECT root, node FROM l{i}" for i in range(n))
    return f"""c{n} AS (SELECT p.root, p.node AS parent, p.lineage AS above, k.dst AS child, k.place, round(greatest(0.0, 0.65 * k.score + 0.35 * coalesce(round(list_cosine_similarity(r.vector, v.vector), 6), 0.0) - 0.02 * {n}), 6) AS score
  FROM l{n - 1} p JOIN {kids} k ON k.src = p.node LEFT JOIN cvec r ON r.node = p.root LEFT JOIN cvec v ON v.node = k.dst WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.root = p.root AND s.node = k.dst)),
b{n} AS (SELECT * FROM c{n} QUALIFY row_number() OVER (PARTITION BY root, child ORDER BY score DESC, above, place) = 1),
l{n} AS (SELECT root, {n} AS depth, child AS node, parent, score, list_append(above, CAST(row_number() OVER (PARTITION BY root, parent ORDER BY score DESC, child) AS INTEGER)) AS lineage FROM b{n})"""


_TREES = f"""WITH {_ROOTS}, {_CVEC}, {_NEAR}, {_kids('kids', 3, _ALL)}, {_kids('deep', 3, "'synonym', 'near_synonym'")}, l0 AS (SELECT node AS root, 0 AS depth, node, CAST(NULL AS VARCHAR) AS parent, 1.0::DOUBLE AS score, CAST([] AS INTEGER[]) AS lineage FROM roots),
{_level(1, 'kids')}, {_level(2, 'deep')}, {_level(3, 'deep')}, trees AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def trees(spark: SparkSession, d: str, width: int = 3, depth: int = 3, alpha: float = expansion.ALPHA, decay: float = expansion.DECAY) -> DataFrame:
    """The trees of every hundredth concept; below the first level only synonyms and near synonyms, and what is nearest, are followed."""
    roots, v = concept_roots(spark, d), concept_vectors(spark, d)
    scratch = Scratch(spark, "trees")  # what every level reads is computed once
    kids, deep = concept_children(spark, d, (width, tuple(t for t, _ in _TIERS)), (width, ("synonym", "near_synonym")))
    nodes = roots.select(F.col("node").alias("root"), "node")
    # the likeness of a root and a node is needed only for nodes within reach of it
    reach = frontier = nodes
    for n in range(depth):
        step = (kids if n == 0 else deep).select(F.col("src").alias("node"), "dst")
        frontier = frontier.join(step, "node").select("root", F.col("dst").alias("node")).distinct()
        reach = reach.unionByName(frontier)
    rv, nv = v.select(F.col("node").alias("root"), F.col("vector").alias("rv")), v.select("node", F.col("vector").alias("nv"))
    origin = reach.distinct().join(rv, "root").join(nv, "node").select("root", "node", F.round(cosine(F.col("rv"), F.col("nv")), 6).alias("sim"))
    return expansion.grow(roots, kids, deep, scratch.write(origin, "origin"), depth, alpha, decay)


@R.query(f"{_TREES} SELECT root, depth, node, parent, score, array_to_string(lineage, '.') AS lineage FROM trees")
def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """Trees of width 3 and depth 3."""
    return trees(spark, d).withColumn("lineage", F.array_join("lineage", "."))


@R.query(f"{_TREES}, per AS (SELECT root, depth, count(*) AS n, max(score) AS best FROM trees GROUP BY ALL) SELECT root, sum(n)::BIGINT AS n_nodes, max(depth) AS depth, round(max(best) FILTER (WHERE depth > 0), 6) AS best, sum(n) <= 40 AS within_limit FROM per GROUP BY root")
def tree_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Size, depth and best score of each tree, and that none exceeds the most results its width and depth allow."""
    t = trees(spark, d)
    return t.groupBy("root").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.max(F.when(F.col("depth") > 0, F.col("score"))).alias("best"), (F.count("*") <= fixed.MAX_RESULTS[3, 3]).alias("within_limit"))


@R.query(f"{_TREES}, r AS (SELECT root, node, depth, left(node, 3) AS lane, row_number() OVER (PARTITION BY root, left(node, 3) ORDER BY depth, score DESC, node) AS turn FROM trees) SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth > 0, turn, lane, node) AS place FROM r", longs=("place",))
def interleave(spark: SparkSession, d: str) -> DataFrame:
    """A tree's nodes in turn over lanes, the root first; the beginnings of slugs stand in for languages."""
    t = trees(spark, d).withColumn("lane", F.left("node", F.lit(3)))
    t = t.withColumn("turn", F.row_number().over(Window.partitionBy("root", "lane").orderBy("depth", F.desc("score"), "node")))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.col("depth") > 0, "turn", "lane", "node"))).select("root", "node", "place")


@R.query(f"""WITH {_CVEC}, {_kids('wide', 5, _ALL, True)}, {_kids('narrow', 5, "'synonym'", True)} SELECT w.src, w.dst FROM wide w WHERE NOT EXISTS (SELECT 1 FROM narrow n WHERE n.src = w.src AND n.dst = w.dst)""")
def parked_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a restriction to synonyms would lose."""
    wide = expansion.children(concept_edges(spark, d), 5).select("src", "dst")
    return wide.join(expansion.children(concept_edges(spark, d, ("synonym",)), 5).select("src", "dst"), ["src", "dst"], "left_anti")


@R.query(f"""WITH {_CVEC}, {_kids('kids', 5, _ALL, True)}, n AS (SELECT src, count(*) AS n FROM kids GROUP BY src), t AS (SELECT r.src, r.dst, row_number() OVER (PARTITION BY r.src ORDER BY r.dst) AS p FROM
  (SELECT DISTINCT {_slug('target_concept_slug')} AS src, {_slug('source_concept_slug')} AS dst FROM concept_relationships WHERE {_slug('relationship_type')} = 'narrower') r WHERE r.src <> r.dst AND NOT EXISTS (SELECT 1 FROM kids k WHERE k.src = r.src AND k.dst = r.dst) QUALIFY p <= 5)
SELECT t.src, t.dst, t.p AS fill FROM t LEFT JOIN n ON n.src = t.src WHERE t.p <= 5 - coalesce(n.n, 0)""", longs=("fill",))
def pivot_top_up(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with fewer than five children filled up from the reversed narrower relation."""
    kids = expansion.children(concept_edges(spark, d), 5)
    r = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "narrower").select(slug_key("target_concept_slug").alias("src"), slug_key("source_concept_slug").alias("dst")).filter("src <> dst").distinct()
    r = top_per_key(r.join(kids.select("src", "dst"), ["src", "dst"], "left_anti"), ["src"], [F.asc("dst")], 5, "fill")
    n = kids.groupBy("src").agg(F.count("*").alias("n"))
    return r.join(n, "src", "left").filter(F.col("fill") <= 5 - F.coalesce("n", F.lit(0))).select("src", "dst", "fill")


_LADDER = f"""WITH {{t}} AS (SELECT n.sense_id AS anchor_id, g.id AS language_id, lower({_trim("o ->> 'word'")}) AS target FROM ({_nested_sql('translations')}) n JOIN languages g ON g.code = o ->> 'code' WHERE n.sense_id % {EVERY} = 0 AND o ->> 'word' IS NOT NULL),
vs AS (SELECT s.id AS sense_id, s.lexeme_id, s.sense_index, s.definition, x.lemma, lower(x.normalized_lemma) AS k, x.language_id, g.code AS language, CAST(e.embedding AS DOUBLE[]) AS vector FROM senses s JOIN lexemes x ON x.id = s.lexeme_id JOIN languages g ON g.id = x.language_id LEFT JOIN embeddings e ON e.vec_id = s.id WHERE s.visibility_status = 'visible'),
q AS (SELECT sense_id AS anchor_id, lemma, k, vector FROM vs WHERE language = 'en' AND sense_id % {EVERY} = 0),
syn AS (SELECT DISTINCT language_code, lower(lemma) AS k, synset_id AS ili FROM raw_entries WHERE synset_id IS NOT NULL AND lemma IS NOT NULL),
mine AS (SELECT DISTINCT q.anchor_id, s.ili FROM q JOIN syn s ON s.language_code = 'en' AND s.k = q.k), own AS (SELECT DISTINCT v.sense_id, v.lexeme_id, s.ili FROM vs v JOIN syn s ON s.language_code = v.language AND s.k = v.k WHERE v.language <> 'en'),
links AS (SELECT DISTINCT t.anchor_id, x.id AS lexeme_id, x.id = min(x.id) OVER (PARTITION BY t.anchor_id, t.language_id, t.target) AS original FROM t JOIN lexemes x ON x.language_id = t.language_id AND lower(x.normalized_lemma) = t.target JOIN q ON q.anchor_id = t.anchor_id),
l1 AS (SELECT anchor_id, lexeme_id, bool_or(original) AS original FROM links GROUP BY ALL),
c0 AS (SELECT l.*, v.sense_id, v.language, v.sense_index, v.lemma, v.definition, q.lemma AS word, round(greatest(0.0, coalesce(list_cosine_similarity(q.vector, v.vector), 0.0)), 6) AS sim FROM l1 l JOIN q USING (anchor_id) JOIN vs v USING (lexeme_id) WHERE v.language <> 'en'),
c1 AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(word, '')), '\\p{{L}}+')) AS own, list_distinct(regexp_extract_all(lower(coalesce(definition, '')), '\\p{{L}}+')) AS def FROM c0 QUALIFY row_number() OVER (PARTITION BY anchor_id, lexeme_id ORDER BY sim DESC, sense_id) <= 5),
c2 AS (SELECT *, round(sim + CASE WHEN len(own) > 0 AND list_has_all(def, own) AND NOT list_has_any(def, ['vaguely', 'loosely', 'somewhat', 'broadly', 'roughly', 'especially', 'chiefly', 'particularly', 'generally']) THEN 0.02 ELSE 0 END, 6) AS effective FROM c1),
c3 AS (SELECT c.*, (SELECT count(DISTINCT o.ili) FROM own o JOIN mine m ON m.ili = o.ili WHERE o.lexeme_id = c.lexeme_id AND m.anchor_id = c.anchor_id) AS n_shared FROM c2 c QUALIFY row_number() OVER (PARTITION BY anchor_id, lexeme_id ORDER BY effective DESC, sense_id) = 1),
fl AS (SELECT unnest({{codes}}) AS language, unnest({{rescue}}) AS rescue, unnest({{fallback}}) AS fallback),
linked AS (SELECT c.*, CASE WHEN sim >= coalesce(rescue, 0.0) THEN n_shared ELSE 0 END AS n FROM c3 c LEFT JOIN fl USING (language) QUALIFY row_number() OVER (PARTITION BY anchor_id, language ORDER BY n_shared = 0, CASE WHEN sim >= coalesce(rescue, 0.0) THEN n_shared ELSE 0 END DESC,
  round(effective + CASE WHEN original THEN 0.01 ELSE 0 END, 6) DESC, coalesce(sense_index, 2147483647), lemma || chr(1114111), sense_id) = 1),
p0 AS (SELECT m.anchor_id, o.sense_id, count(DISTINCT o.ili) AS n_shared FROM own o JOIN mine m ON m.ili = o.ili GROUP BY ALL),
p1 AS (SELECT p.*, v.language, round(greatest(0.0, coalesce(list_cosine_similarity(q.vector, v.vector), 0.0)), 6) AS sim FROM p0 p JOIN q USING (anchor_id) JOIN vs v USING (sense_id) WHERE v.vector IS NOT NULL),
pool AS (SELECT p.anchor_id, p.language, p.sense_id, p.sim, CASE WHEN sim >= coalesce(rescue, 0.0) THEN n_shared ELSE 0 END AS n FROM p1 p LEFT JOIN fl USING (language) QUALIFY row_number() OVER (PARTITION BY anchor_id, language ORDER BY CASE WHEN sim >= coalesce(rescue, 0.0) THEN n_shared ELSE 0 END DESC, sim DESC, sense_id) = 1),
near AS (SELECT q.anchor_id, v.language, v.sense_id, round(list_cosine_similarity(q.vector, v.vector), 6) AS sim FROM q JOIN vs v ON v.vector IS NOT NULL AND q.vector IS NOT NULL AND v.language <> 'en' QUALIFY row_number() OVER (PARTITION BY q.anchor_id, v.language ORDER BY round(list_cosine_similarity(q.vector, v.vector), 6) DESC, v.sense_id) = 1),
j AS (SELECT q.anchor_id, g.code AS language, l.sense_id AS ls, l.sim AS lsim, l.n AS ln, CASE WHEN l.n_shared > 0 THEN 'corroborated' ELSE 'primary' END AS lr, p.sense_id AS ps, p.sim AS psim, p.n AS pn, f.rescue, n.sense_id AS ns, n.sim AS nsim, n.sim >= f.fallback AS close, EXISTS (SELECT 1 FROM mine m WHERE m.anchor_id = q.anchor_id) AS has
  FROM q JOIN languages g ON g.code <> 'en' LEFT JOIN linked l ON l.anchor_id = q.anchor_id AND l.language = g.code LEFT JOIN pool p ON p.anchor_id = q.anchor_id AND p.language = g.code LEFT JOIN fl f ON f.language = g.code LEFT JOIN near n ON n.anchor_id = q.anchor_id AND n.language = g.code),
r AS (SELECT *, CASE WHEN ls IS NOT NULL AND has AND ln <= 1 AND ps IS NOT NULL AND pn >= 2 AND pn > ln AND psim >= coalesce(rescue, 0.0) THEN 'ili_override' WHEN ls IS NOT NULL THEN lr WHEN ps IS NOT NULL THEN 'ili' WHEN close THEN 'fallback' ELSE 'none' END AS rung FROM j),
ladder AS (SELECT anchor_id, language, rung, CASE rung WHEN 'ili_override' THEN ps WHEN 'ili' THEN ps WHEN 'fallback' THEN ns WHEN 'none' THEN NULL ELSE ls END AS sense_id, CASE rung WHEN 'ili_override' THEN psim WHEN 'ili' THEN psim WHEN 'fallback' THEN nsim WHEN 'none' THEN NULL ELSE lsim END AS sim FROM r)"""
_FLOOR_CODES = sorted({*fixed.RESCUE_FLOORS, *fixed.FALLBACK_FLOORS})
_LADDER = _LADDER.replace("{t}", "t").replace("{codes}", str(_FLOOR_CODES)).replace("{rescue}", str([fixed.RESCUE_FLOORS.get(g) for g in _FLOOR_CODES])).replace("{fallback}", str([fixed.FALLBACK_FLOORS.get(g) for g in _FLOOR_CODES]))


def ladder(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "lemma", F.lower("normalized_lemma").alias("k"))
    g = F.broadcast(table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("code").alias("language")))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("sense_id"), F.col("embedding").alias("vector"))
    s = table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("id").alias("sense_id"), "lexeme_id", "sense_index", "definition")
    scratch = Scratch(spark, "roots")
    seen = scratch.write(s.join(x, "lexeme_id").join(g, "language_id").join(v, "sense_id", "left"), "senses")
    anchors = scratch.write(seen.filter((F.col("language") == "en") & (F.col("sense_id") % EVERY == 0)).select(F.col("sense_id").alias("anchor_id"), "lemma", "k", "vector"), "anchors")
    syn = table(spark, d, "raw_entries").filter("synset_id IS NOT NULL AND lemma IS NOT NULL").select(F.col("language_code").alias("language"), F.lower("lemma").alias("k"), F.col("synset_id").alias("ili")).distinct()
    mine = anchors.join(syn.filter("language = 'en'"), "k").select("anchor_id", "ili")
    other = seen.filter("language <> 'en'")
    own = other.select("sense_id", "language", "k").join(syn, ["language", "k"]).select("sense_id", "ili")
    t = _nested(spark, d, "translations").filter(F.col("sense_id") % EVERY == 0).join(g.withColumnRenamed("language", "code"), "code").select(F.col("sense_id").alias("anchor_id"), "language_id", F.lower(trimmed("word")).alias("k")).distinct()
    j = t.join(anchors.select("anchor_id"), "anchor_id").join(x.select("lexeme_id", "language_id", "k"), ["language_id", "k"])
    first = j.groupBy("anchor_id", "language_id", "k").agg(F.min("lexeme_id").alias("first"))
    links = j.join(first, ["anchor_id", "language_id", "k"]).select("anchor_id", "lexeme_id", (F.col("lexeme_id") == F.col("first")).alias("original"))
    goals = table(spark, d, "languages").filter("code <> 'en'").select(F.col("code").alias("language"), F.col("id").alias("number"))
    return roots_of.select_roots(anchors, mine, scratch.write(links, "links"), other.select("sense_id", "lexeme_id", "language", "sense_index", "lemma", "definition", "vector"), scratch.write(own, "ilis"), goals)


@R.query(f"{_LADDER} SELECT anchor_id, language, rung, sense_id, round(sim, 6) AS sim FROM ladder")
def root_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The root of every hundredth English sense in each language, by the best evidence there is; "none" where there is none."""
    return ladder(spark, d)


@R.query(f"{_LADDER} SELECT language, rung, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY language), 6) AS share FROM ladder GROUP BY language, rung")
def rung_census(spark: SparkSession, d: str) -> DataFrame:
    """How often each rung decides, by language."""
    n = ladder(spark, d).groupBy("language", "rung").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("language")), 6))


@R.query(f"""WITH {_CVEC}, {_kids('kids', 5, _ALL, True)}, have AS (SELECT DISTINCT {_slug('concept_slug')} AS slug, language_code FROM word_senses WHERE is_primary AND {_slug('concept_slug')} IS NOT NULL), {_ROOTS}, goals AS (SELECT code AS language_code FROM languages),
need AS (SELECT r.node, g.language_code FROM roots r, goals g WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.slug = r.node AND h.language_code = g.language_code))
SELECT n.node, n.language_code, min_by(k.dst, k.place) AS anchor FROM need n JOIN kids k ON k.src = n.node JOIN have h ON h.slug = k.dst AND h.language_code = n.language_code WHERE k.score >= 0.3 GROUP BY ALL""")
def pivot_rescue(spark: SparkSession, d: str) -> DataFrame:
    """For a concept without a word in a language, its first child of sufficient score that has one."""
    have = table(spark, d, "word_senses").filter("is_primary").select(slug_key("concept_slug").alias("slug"), "language_code").dropna().distinct()
    kids = expansion.children(concept_edges(spark, d), 5).filter("score >= 0.3")
    roots = concept_roots(spark, d).withColumnRenamed("node", "src")
    offered = roots.join(kids, "src").join(have.withColumnRenamed("slug", "dst"), "dst")
    missing = offered.join(have.select(F.col("slug").alias("src"), "language_code"), ["src", "language_code"], "left_anti")
    known = table(spark, d, "languages").select(F.col("code").alias("language_code"))
    return edges.first_row(missing.join(known, "language_code", "left_semi"), ["src", "language_code"], [F.col("place")], "dst").select(F.col("src").alias("node"), "language_code", F.col("dst").alias("anchor"))


@R.query(f"""WITH e AS (SELECT DISTINCT {_slug('source_concept_slug')} AS slug FROM concept_relationships WHERE {_slug('relationship_type')} IN ('synonym')), w AS (SELECT DISTINCT language_code, {_slug('concept_slug')} AS slug FROM word_senses)
SELECT g.code, coalesce(g.has_wordnet_edges, NOT EXISTS (SELECT 1 FROM w JOIN e ON e.slug = w.slug WHERE w.language_code = g.code)) AS eligible FROM languages g""")
def pivot_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """The stored flag of a language, or else whether none of its concepts has an edge."""
    e = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "synonym").select(slug_key("source_concept_slug").alias("slug")).filter("slug IS NOT NULL").distinct()
    w = table(spark, d, "word_senses").select(F.col("language_code").alias("code"), slug_key("concept_slug").alias("slug")).distinct().join(e, "slug", "left_semi").select("code").distinct().withColumn("linked", F.lit(True))
    return table(spark, d, "languages").select("code", "has_wordnet_edges").join(w, "code", "left").select("code", F.coalesce("has_wordnet_edges", F.col("linked").isNull()).alias("eligible"))


@R.query(f"""WITH {_SENSES}, e AS (SELECT n.sense_id, lower(o ->> 'word') AS target FROM ({_nested_sql('synonyms')}) n WHERE o ->> 'word' IS NOT NULL), d AS (SELECT language_id, lower(normalized_lemma) AS target, min_by(sense_id, (coalesce(sense_index, 2147483647), sense_id)) AS to_id FROM ls WHERE visibility_status = 'visible' AND normalized_lemma IS NOT NULL GROUP BY 1, 2)
SELECT e.sense_id AS from_id, d.to_id, 0 AS tier FROM (SELECT DISTINCT * FROM e) e JOIN ls ON ls.sense_id = e.sense_id JOIN d ON d.language_id = ls.language_id AND d.target = e.target WHERE d.to_id <> e.sense_id""")
def edge_collect(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms joined to the sense their word is displayed by."""
    ls = lexeme_senses(spark, d)
    shown = edges.primary_senses(ls.filter("visibility_status = 'visible' AND normalized_lemma IS NOT NULL").withColumn("target", F.lower("normalized_lemma")), ["language_id", "target"]).withColumnRenamed("sense_id", "to_id")
    e = _nested(spark, d, "synonyms").select("sense_id", F.lower("word").alias("target")).distinct().join(ls.select("sense_id", "language_id"), "sense_id")
    return e.join(shown, ["language_id", "target"]).filter("to_id <> sense_id").select(F.col("sense_id").alias("from_id"), "to_id", F.lit(0).alias("tier"))
