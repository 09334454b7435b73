"""Queries of names, counts and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions import fixed
from lexiweave.functions.keys import slug_key
from lexiweave.operators import measures, names, propagation
from lexiweave.operators.lookup import top_per_key
from lexiweave.operators.ordering import places
from lexiweave.plans.registry import Registry
from lexiweave.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _slug(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# ---- names; the patterns of the SQL are its own

_PLACE = "(?:city|town|village|hamlet|river|mountain|lake|island|state|province|country|county|region|district|commune|municipality|borough|suburb|neighborhood|neighbourhood|census-designated place|unincorporated|placename|place name|place-name|locality|locale|civil parish|parish|prefecture|ward|settlement|community|ghost town|local government area)"
_KIND = rf"""CASE WHEN t = '' THEN 'OTHER'
 WHEN regexp_matches(t, '(?i)^(?:(?:nomin|genit|accus|vocat|locat)(?:a?t)?ive|dative|ablative|instrumental|oblique)\b.{{0,40}}\bof\b') OR regexp_matches(t, '(?i)^(?:alternative|variant|obsolete|archaic) (?:form|spelling) of\b')
   OR regexp_matches(t, '(?i)\b(?:singular|plural|definite|indefinite) of\b') OR regexp_matches(t, '(?i)^(?:inflection|romanization|transliteration) of\b') THEN 'FORM_OF'
 WHEN regexp_matches(t, '(?i)\b(?:(?:given|first) name|forename)\b') OR regexp_matches(t, '(?i)^an? (?:male|female|unisex|masculine|feminine) name\b') THEN 'GIVEN'
 WHEN regexp_matches(t, '(?i)\b(?:surname|(?:family|last) name)\b') THEN 'SURNAME'
 WHEN regexp_matches(t, '(?i)\b[pm]atronymic\b') THEN 'PATRONYMIC'
 WHEN regexp_matches(t, '(?i)^an? (?:[a-z-]+ ){{0,3}}{_PLACE}\b') OR regexp_matches(t, '(?i)^an? place (?:in|of)\b') OR regexp_matches(t, '(?i)^a number of places\b') OR regexp_matches(t, '(?i)^the capital (?:city )?of\b')
   OR regexp_matches(t, '(?i)\((?:an?|the) {_PLACE}\b') THEN 'PLACE' ELSE 'OTHER' END"""
_TAGGED = "list_has_any(list_transform(coalesce(raw_tags, []), lambda x: lower(trim(x))), ['form-of', 'alt-of', 'alternative'])"


@R.query(f"""WITH d AS (SELECT doc_id, doc_kind, {_trim("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, {_KIND} AS name_type FROM d""")
def name_type(spark: SparkSession, d: str) -> DataFrame:
    """What kind of name each document tells of."""
    return table(spark, d, "documents").select("doc_id", names.name_type(F.col("text")).alias("name_type"))


@R.query(f"""WITH s AS (SELECT id AS sense_id, {_trim("coalesce(definition, '')")} AS t, raw_tags FROM senses), k AS (SELECT sense_id, CASE WHEN t <> '' AND {_TAGGED} THEN 'FORM_OF' ELSE {_KIND} END AS kind FROM s)
SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def name_census(spark: SparkSession, d: str) -> DataFrame:
    """Senses by kind of name."""
    return table(spark, d, "senses").groupBy(names.name_type(F.col("definition"), F.col("raw_tags")).alias("kind")).agg(F.count("*").alias("n"))


def name_senses(spark: SparkSession, d: str) -> DataFrame:
    """The senses of names with their language."""
    x = table(spark, d, "lexemes").filter("part_of_speech = 'name'").select(F.col("id").alias("lexeme_id"), "language_id", "normalized_lemma", "romanization")
    g = F.broadcast(table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("name").alias("language"), F.col("code").alias("language_code")))
    return table(spark, d, "senses").join(x, "lexeme_id").join(g, "language_id", "left")


_NAME_KINDS = rf"""s AS (SELECT s.id AS sense_id, s.lexeme_id, x.language_id, x.normalized_lemma, x.romanization, g.name AS language, g.code AS language_code, s.raw_tags, s.categories, coalesce(s.definition, '') AS d, s.etymology_text, {_trim("coalesce(s.definition, '')")} AS t
  FROM senses s JOIN lexemes x ON x.id = s.lexeme_id LEFT JOIN languages g ON g.id = x.language_id WHERE x.part_of_speech = 'name'),
cats AS (SELECT sense_id, lower(language) || ' ' AS begin, lower(trim(regexp_replace(CASE WHEN c LIKE '{{%' THEN regexp_extract(c, '''name'': [''"](.*?)[''"][,}}]', 1) ELSE c END, '\s+', ' ', 'g'))) AS c FROM (SELECT sense_id, language, unnest(categories) AS c FROM s)),
rest AS (SELECT sense_id, substr(c, length(begin) + 1) AS r FROM cats WHERE starts_with(c, begin)),
told AS (SELECT sense_id, r, regexp_extract(r, '((?:pa|ma)tronymic surnames|given names|forenames|surnames|family names|nomina gentilia|(?:pa|ma)tronymics)(?: (?:from|of|in|derived from)\b.*)?$', 1) AS k FROM rest
  WHERE regexp_full_match(r, '(?:(?:possessive|male|masculine|female|feminine|unisex|epicene) )*(?:(?:pa|ma)tronymic surnames|given names|forenames|surnames|family names|nomina gentilia|(?:pa|ma)tronymics)(?: (?:from|of|in|derived from)\b.*)?')
    OR regexp_full_match(r, '(?:renderings|diminutives|augmentatives) of (?:[^ ]+ )*(?:(?:pa|ma)tronymic surnames|given names|forenames|surnames|family names|nomina gentilia|(?:pa|ma)tronymics)')),
hits AS (SELECT sense_id, CASE WHEN k LIKE '%tronymic%' THEN 2 WHEN k IN ('given names', 'forenames') THEN 0 ELSE 1 END AS k, CASE WHEN regexp_matches(r, '\b(?:female|feminine)\b') THEN 'f' WHEN regexp_matches(r, '\b(?:male|masculine)\b') THEN 'm' WHEN regexp_matches(r, '\b(?:unisex|epicene)\b') THEN 'x' ELSE 'u' END AS g FROM told),
best AS (SELECT sense_id, min(k) AS k, bool_or(k = 1) AS has_surname FROM hits GROUP BY sense_id),
bestg AS (SELECT b.sense_id, b.k, b.has_surname, list_distinct(list(h.g) FILTER (WHERE h.g <> 'u')) AS gs FROM best b JOIN hits h ON h.sense_id = b.sense_id AND h.k = b.k GROUP BY ALL),
heads AS (SELECT *, regexp_extract(lower(d), '\b(female|feminine|male|masculine|unisex|epicene)\s+(?:\w+\s+){{0,2}}?(?:given\s+name|surname|family\s+name|patronymic|matronymic|name)\b', 1) AS w,
  regexp_matches(d, '(?i)\b(?:male\s+(?:or|and)\s+female|female\s+(?:or|and)\s+male|common[- ]gender)\b') AS pair, CASE WHEN t <> '' AND {_TAGGED} THEN 'FORM_OF' ELSE {_KIND} END AS by_gloss FROM s),
kinds AS (SELECT h.*, coalesce(CASE b.k WHEN 0 THEN 'GIVEN' WHEN 1 THEN 'SURNAME' WHEN 2 THEN 'PATRONYMIC' END, by_gloss) AS k, b.has_surname AND b.k <> 1 AS flagged,
  CASE len(coalesce(b.gs, [])) WHEN 0 THEN CASE WHEN pair THEN 'x' WHEN w LIKE 'f%' THEN 'f' WHEN w LIKE 'm%' THEN 'm' WHEN w <> '' THEN 'x' ELSE 'u' END WHEN 1 THEN b.gs[1] ELSE 'x' END AS g FROM heads h LEFT JOIN bestg b USING (sense_id)),
named AS (SELECT sense_id, lexeme_id, language_id, language_code, normalized_lemma, romanization, d, etymology_text, CASE WHEN by_gloss = 'FORM_OF' THEN 'FORM_OF' ELSE k END AS kind, CASE WHEN by_gloss = 'FORM_OF' THEN 'u' ELSE g END AS gender,
  by_gloss <> 'FORM_OF' AND (coalesce(flagged, false) OR (k IN ('GIVEN', 'PATRONYMIC') AND regexp_matches(d, '(?i)\b(?:(?:given|first) name|forename)\b|^an? (?:male|female|unisex|masculine|feminine) name\b') AND regexp_matches(d, '(?i)\b(?:surname|(?:family|last) name)\b'))) AS also_surname FROM kinds)"""


def _meaning(gloss: str, etymology: str, code: str, rows: str, keep: str) -> str:
    """CTEs up to m(keep, channel, meaning)."""
    mark = """(?i:meaning|literally|lit\\.)\\s*["“''‘«]([^"”''’»]{1,80})["”''’»]"""
    clean = lambda c: rf"""regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '^[ ,;:.]+|[ ,;:.]+$', '', 'g')"""
    fits = lambda c: rf"CASE WHEN length({c}) BETWEEN 1 AND 400 AND regexp_matches({c}, '\p{{L}}') THEN {c} END"
    return rf"""q0 AS (SELECT {keep}, {gloss} AS gl, {etymology} AS et, {code} AS co FROM {rows}),
q1 AS (SELECT *, split_part(regexp_replace(regexp_replace({_trim('et')}, '([.!?])\s+([A-ZͰ-ϿЀ-ӿ])', '\1' || chr(30) || '\2', 'g'), '((?:^|[^\p{{L}}\d])(?i:cf|e\.g|i\.e|lit|ca|c|fl|mr|st)\.)' || chr(30), '\1 ', 'g'), chr(30), 1) AS first FROM q0),
q2 AS (SELECT *, list_concat(regexp_extract_all(first, '{mark}', 1), flatten(list_transform(regexp_extract_all(first, '\(([^()]{{0,300}})\)', 1), lambda p: regexp_extract_all(p, '["“«]([^"”»]{{1,80}})["”»]', 1)))) AS raw,
  regexp_replace(regexp_replace(first, '\([^()]{{0,300}}\)', ' ', 'g'), '["“«][^"”»]{{1,80}}["”»]', ' ', 'g') AS bare FROM q1),
q3 AS (SELECT *, list_filter(list_transform(raw, lambda s: trim(regexp_replace(trim(s), '^[,;:]+|[,;:]+$', '', 'g'))), lambda s: regexp_matches(s, '[A-Za-z]') AND length(s) <= 80
  AND NOT regexp_matches(s, '(?i)^(?:stem|continuative|attributive|conjunctive|combining|inflect\w*|(?:im)?perfective|classical|literary|colloquial|honorific)\b|^(?:(?:an?|the) )?(?:form|variant|spelling|reading|romani[sz]ation|trans(?:literation|cription)|abbreviation|contraction)\b|\bof the (?:verb|noun|adjective|name)\b|^(?:see|cf\.?|compare|given name|surname|personal name|a name)\b')) AS spans FROM q2),
q4 AS (SELECT *, list_filter(spans, lambda s, i: list_position(list_transform(spans, lambda y: lower(y)), lower(s)) = i) AS once FROM q3),
q5 AS (SELECT {keep}, {clean(f"regexp_extract(gl, '{mark}', 1)")} AS a, {clean(f"regexp_extract(et, '{mark}', 1)")} AS b, CASE WHEN coalesce(co, '') NOT IN ('ja', 'zh') AND len(once) > 0
  AND regexp_matches(bare, '(?i)\b(?:from|cognate with|(?:calque|contraction) of|compo(?:sed|und) of|equivalent to|via)\b') THEN {clean("array_to_string(once[1:4], ' + ')")} END AS c FROM q4),
m AS (SELECT {keep}, CASE WHEN {fits('a')} IS NOT NULL THEN 'GLOSS_MEANING' WHEN {fits('b')} IS NOT NULL THEN 'ETYM_MARKER' WHEN {fits('c')} IS NOT NULL THEN 'ETYM_QUOTED' END AS channel, coalesce({fits('a')}, {fits('b')}, {fits('c')}) AS meaning FROM q5)"""


@R.query(f"WITH {_NAME_KINDS} SELECT sense_id, kind, gender, also_surname FROM named")
def name_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kind, gender and use as a surname of each sense of a name."""
    c = names.classify_name(F.col("definition"), F.col("raw_tags"), F.col("categories"), F.col("language"))
    return name_senses(spark, d).select(F.col("id").alias("sense_id"), c.alias("c")).select("sense_id", "c.kind", "c.gender", "c.also_surname")


@R.query(f"WITH {_meaning('text', 'text', 'lang', 'documents', 'doc_id')} SELECT doc_id, channel, meaning FROM m")
def meaning_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """The meaning that each document tells, by the first channel that gives one."""
    channel, meaning = names.meaning_of(F.col("text"), F.col("text"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", channel.alias("channel"), meaning.alias("meaning"))


@R.query(r"""WITH c AS (SELECT channel FROM (SELECT CASE WHEN regexp_matches(text, '(?i:meaning|literally|lit\.)\s*["“''‘«][^"”''’»]{1,80}["”''’»]') THEN 'MARK' END AS a, CASE WHEN regexp_matches(text, '\bequivalent to English\s+[A-Z]') THEN 'EQUIVALENT' END AS b,
  CASE WHEN regexp_matches(text, '["“«][^"”»]{1,80}["”»]') THEN 'QUOTED' END AS c FROM documents), unnest([a, b, c]) AS t(channel)) SELECT channel, count(*) AS n FROM c WHERE channel IS NOT NULL GROUP BY channel""")
def channel_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents by what they offer as a meaning, each counted under all of it."""
    text, said = F.col("text"), [("MARK", "(?iU)" + fixed.MEANING_MARK), ("EQUIVALENT", r"\bequivalent to English\s+[A-Z]"), ("QUOTED", fixed.QUOTED_SPAN)]
    found = F.array(*[F.when(text.rlike(p), n) for n, p in said])
    return table(spark, d, "documents").select(F.explode(found).alias("channel")).filter("channel IS NOT NULL").groupBy("channel").agg(F.count("*").alias("n"))


@R.query(r"""WITH t AS (SELECT id AS sense_id, list_filter(regexp_extract_all(lower(definition), '\p{L}{3,}'), lambda w: NOT list_contains(string_split('the and from for with was are were been this that these those its his her their our your she they you also see used use using such more most very not name names given surname surnames family first last male female masculine feminine unisex form forms variant variants spelling diminutive short pet equivalent english meaning literally lit means derived derivative cognate son daughter child born place city town river god goddess mythology saint one two three ancient modern old new common word words letter', ' '), w)) AS ws FROM senses),
p AS (SELECT sense_id, w, min(i) AS i FROM (SELECT sense_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t) GROUP BY 1, 2), k AS (SELECT sense_id, w AS token, row_number() OVER (PARTITION BY sense_id ORDER BY i) AS place FROM p QUALIFY place <= 12),
v AS (SELECT x.normalized_lemma, min(x.id) AS lexeme_id FROM lexemes x JOIN languages g ON g.id = x.language_id WHERE g.code = 'en' AND EXISTS (SELECT 1 FROM senses s WHERE s.lexeme_id = x.id AND s.visibility_status = 'visible') GROUP BY 1)
SELECT k.sense_id, k.token, v.lexeme_id FROM k LEFT JOIN v ON v.normalized_lemma = k.token""")
def meaning_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The words of definitions as join keys, with the first visible English lexeme of each."""
    t = table(spark, d, "senses").select(F.col("id").alias("sense_id"), F.explode(names.meaning_tokens(F.col("definition"))).alias("token"))
    english = F.broadcast(table(spark, d, "languages").filter("code = 'en'").select(F.col("id").alias("language_id")))
    visible = table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("lexeme_id").alias("id"))
    x = table(spark, d, "lexemes").join(english, "language_id", "left_semi").join(visible, "id", "left_semi").groupBy(F.col("normalized_lemma").alias("token")).agg(F.min("id").alias("lexeme_id"))
    return t.join(x, "token", "left").select("sense_id", "token", "lexeme_id")


@R.query(f"""WITH {_NAME_KINDS}, {_meaning('d', 'etymology_text', 'language_code', "named WHERE kind IN ('GIVEN', 'SURNAME', 'PATRONYMIC', 'OTHER')", 'sense_id, language_id, normalized_lemma, gender, romanization')},
r AS (SELECT *, CASE channel WHEN 'GLOSS_MEANING' THEN 0 WHEN 'ETYM_MARKER' THEN 1 WHEN 'ETYM_QUOTED' THEN 2 ELSE 9 END AS rank FROM m),
g AS (SELECT language_id, normalized_lemma, min_by(sense_id, (rank, sense_id)) AS row_id, count(*) AS n_rows, list_distinct(list(gender) FILTER (WHERE gender <> 'u')) AS gs, min_by(romanization, sense_id) FILTER (WHERE romanization IS NOT NULL) AS romanization FROM r GROUP BY 1, 2),
h AS (SELECT x.language_id, x.normalized_lemma, min(x.id) AS lexeme_id FROM lexemes x WHERE x.part_of_speech <> 'name' AND EXISTS (SELECT 1 FROM senses s WHERE s.lexeme_id = x.id AND s.visibility_status = 'visible') GROUP BY 1, 2)
SELECT g.language_id, g.normalized_lemma, g.row_id, r.channel, r.meaning, CASE coalesce(len(gs), 0) WHEN 0 THEN 'u' WHEN 1 THEN gs[1] ELSE 'x' END AS gender, g.n_rows, g.romanization, h.lexeme_id AS homograph_lexeme_id
FROM g JOIN r ON r.sense_id = g.row_id LEFT JOIN h ON h.language_id = g.language_id AND h.normalized_lemma = g.normalized_lemma""")
def name_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each name and language: its best meaning, joined gender and romanization, and the common word that is spelt alike."""
    c = names.classify_name(F.col("definition"), F.col("raw_tags"), F.col("categories"), F.col("language"))
    channel, meaning = names.meaning_of(F.col("definition"), F.col("etymology_text"), F.col("language_code"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, fixed.MEANING_CHANNELS)), channel).cast("int") - 1, F.lit(9))
    rows = name_senses(spark, d).withColumn("c", c).filter(F.col("c.kind").isin("GIVEN", "SURNAME", "PATRONYMIC", "OTHER"))
    rows = rows.select("language_id", "normalized_lemma", rank.alias("rank"), F.col("id").alias("row_id"), channel.alias("channel"), meaning.alias("meaning"), "c.gender", "romanization")
    visible = table(spark, d, "senses").filter("visibility_status = 'visible'").select(F.col("lexeme_id").alias("id"))
    common = table(spark, d, "lexemes").filter("part_of_speech <> 'name'").join(visible, "id", "left_semi").groupBy("language_id", "normalized_lemma").agg(F.min("id").alias("homograph_lexeme_id"))
    keyed, common = names.name_groups(rows, ["language_id", "normalized_lemma"]).alias("k"), common.alias("h")
    return keyed.join(common, ["language_id", "normalized_lemma"], "left")


@R.query(r"""WITH d AS (SELECT 'sense' AS of, id, definition AS t FROM senses UNION ALL SELECT 'document', doc_id, text FROM documents),
r AS (SELECT of, id, k.relation, string_split_regex(regexp_extract(t, k.pattern, 1), '[.;]')[1] AS rest FROM d, (VALUES ('EQUIV_EN', '(?i)\bequivalent to english\s+(.+)'), ('VARIANT_OF', '(?i)\bvariant of\s+(.+)'), ('DIMINUTIVE_OF', '(?i)\b(?:diminutive|pet form|short form|hypocorism|hypocoristic|nickname)(?:\s+(?:of|for))?\s+(.+)'),
  ('FEM_EQUIV', '(?i)\bfeminine equivalents?\s+(.+)'), ('MASC_EQUIV', '(?i)\bmasculine equivalents?\s+(.+)')) k(relation, pattern) WHERE t IS NOT NULL),
p AS (SELECT of, id, relation, list_transform(string_split_regex(rest, '(?i)\s*,\s*|\s+or\s+|\s+and\s+'), lambda x: trim(regexp_replace(x, '\([^)]*\)', '', 'g'))) AS xs FROM r),
w AS (SELECT of, id, relation, list_filter(list_transform(xs, lambda x: regexp_replace(regexp_extract(regexp_replace(x, '(?i)^(?:(?:the|an?|male|female|unisex|masculine|feminine|given name|surname)\s+){0,4}', ''), '^\S+'), '^[.,;:—’''"-]+|[.,;:—’''"-]+$', '', 'g')), lambda x: x <> '')[1:3] AS ts FROM p)
SELECT of, id, relation, unnest(ts) AS target FROM w""")
def name_targets(spark: SparkSession, d: str) -> DataFrame:
    """The names that definitions and documents point to behind a phrase of relation."""
    s = table(spark, d, "senses").select(F.lit("sense").alias("of"), "id", F.col("definition").alias("t"))
    t = table(spark, d, "documents").select(F.lit("document").alias("of"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return s.unionByName(t).select("of", "id", F.explode(names.trigger_targets(F.col("t"))).alias("x")).select("of", "id", "x.relation", "x.target")


@R.query(f"""WITH RECURSIVE e AS (SELECT {_slug('source_concept_slug')} AS a, {_slug('target_concept_slug')} AS b FROM concept_relationships WHERE {_slug('relationship_type')} = 'contrast'),
l AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a IS NOT NULL AND b IS NOT NULL), r(v, w) AS (SELECT a, a FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
c AS (SELECT v, min(w) AS c FROM r GROUP BY v), n AS (SELECT c, count(*) AS size FROM c GROUP BY c) SELECT size, count(*) AS n_components FROM n GROUP BY size""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the components that contrasts make of concepts."""
    e = table(spark, d, "concept_relationships").filter(slug_key("relationship_type") == "contrast").select(slug_key("source_concept_slug").alias("a"), slug_key("target_concept_slug").alias("b"))
    return propagation.components(e, "a", "b").groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


# ---- counts


@R.query("""SELECT source_slug, count(*) AS n, count(*) FILTER (WHERE review_status = 'reviewed') AS n_reviewed, count(concept_slug) AS n_concepts, count(DISTINCT language_code) AS n_languages, string_agg(DISTINCT confidence, ',' ORDER BY confidence) AS confidences FROM word_senses GROUP BY source_slug""")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    """Word senses by source, with conditional counts and an ordered list of a small domain."""
    return table(spark, d, "word_senses").groupBy("source_slug").agg(
        F.count("*").alias("n"), F.count_if(F.col("review_status") == "reviewed").alias("n_reviewed"), F.count("concept_slug").alias("n_concepts"), F.countDistinct("language_code").alias("n_languages"),
        F.nullif(F.array_join(F.sort_array(F.collect_set("confidence")), ","), F.lit("")).alias("confidences"),
    )


@R.query("""SELECT lexeme_id, max(id) FILTER (WHERE list_contains(raw_tags, 'dialectal')) AS last_id FROM senses GROUP BY lexeme_id HAVING bool_and(coalesce(list_has_any(raw_tags, ['dialectal', 'obsolete', 'archaic']), false))""")
def purely_alt(spark: SparkSession, d: str) -> DataFrame:
    """Lexemes all of whose senses are marked."""
    marked = F.coalesce(F.arrays_overlap(F.filter("raw_tags", lambda t: t.isNotNull()), F.array(*map(F.lit, ("dialectal", "obsolete", "archaic")))), F.lit(False))
    g = table(spark, d, "senses").groupBy("lexeme_id").agg(F.bool_and(marked).alias("all"), F.max(F.when(F.array_contains("raw_tags", "dialectal"), F.col("id"))).alias("last_id"))
    return g.filter("all").drop("all")


@R.query("""WITH domain AS (SELECT unnest(['unreviewed', 'reviewed', 'rejected', 'pending']) AS review_status), n AS (SELECT review_status, count(*) AS n FROM concept_relationships GROUP BY 1) SELECT d.review_status, coalesce(n.n, 0) AS n FROM domain d LEFT JOIN n USING (review_status)""")
def value_domain(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a whole domain, zeros included."""
    domain = spark.createDataFrame([(s,) for s in ("unreviewed", "reviewed", "rejected", "pending")], "review_status string")
    n = table(spark, d, "concept_relationships").groupBy("review_status").agg(F.count("*").alias("n"))
    return domain.join(n, "review_status", "left").na.fill(0)


@R.query("""WITH n AS (SELECT lexeme_id, count(*) AS n FROM senses GROUP BY lexeme_id) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' ELSE '6+' END AS bucket, count(*) AS n_lexemes, round(avg(n), 6) AS mean FROM n GROUP BY bucket""")
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Lexemes by number of senses."""
    n = table(spark, d, "senses").groupBy("lexeme_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 5, "3-5").otherwise("6+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_lexemes"), F.round(F.avg("n"), 6).alias("mean"))


@R.query(r"""WITH t AS (SELECT unnest(regexp_extract_all(lower(definition), '\p{L}+')) AS token FROM senses) SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    """The 50 commonest words of definitions: a top-k report."""
    t = table(spark, d, "senses").select(F.explode(F.regexp_extract_all(F.lower("definition"), F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@R.query("""SELECT event_type, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of values by kind of event."""
    return measures.quantiles(table(spark, d, "events"), ["event_type"], "value", {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")


@R.query("""WITH r AS (SELECT event_type, value, user_id % 2 = 0 AS pos FROM events WHERE value IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM r),
s AS (SELECT event_type, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(rk) FILTER (WHERE pos) AS u FROM k GROUP BY 1) SELECT event_type, n_pos, n_neg, round((u - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc FROM s""")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """How well values part two kinds of users."""
    e = table(spark, d, "events").select("event_type", "value", (F.col("user_id") % 2 == 0).alias("pos"))
    return measures.auc(e, ["event_type"], "value", "pos")


@R.query("""WITH r AS (SELECT source_slug, sense_rank::DOUBLE AS a, length(gloss)::DOUBLE AS b FROM word_senses WHERE sense_rank IS NOT NULL AND gloss IS NOT NULL), k AS (SELECT source_slug, rank() OVER (PARTITION BY source_slug ORDER BY a) + (count(*) OVER (PARTITION BY source_slug, a) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY source_slug ORDER BY b) + (count(*) OVER (PARTITION BY source_slug, b) - 1) / 2.0 AS rb FROM r) SELECT source_slug, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM k GROUP BY source_slug""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of a sense's rank and its gloss's length, by source."""
    w = table(spark, d, "word_senses").select("source_slug", F.col("sense_rank").cast("double").alias("a"), F.length("gloss").cast("double").alias("b"))
    return measures.spearman(w, ["source_slug"], "a", "b")


@R.query("""WITH r AS (SELECT language_code, word, row_number() OVER (PARTITION BY language_code, word ORDER BY selection_count DESC NULLS LAST, sense_id) AS rk, part_of_speech = 'verb' AS rel FROM sense_options WHERE word IS NOT NULL),
f AS (SELECT language_code, word, min(rk) FILTER (WHERE rel) AS r FROM r GROUP BY 1, 2) SELECT language_code, count(*) AS n_queries, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, count(*) FILTER (WHERE r = 1) AS top1, count(*) FILTER (WHERE r <= 3) AS top3 FROM f GROUP BY language_code""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Where a word's first verb stands when its senses are ordered by selections."""
    o = table(spark, d, "sense_options").filter("word IS NOT NULL").select("language_code", "word", "sense_id", "selection_count", (F.col("part_of_speech") == "verb").alias("rel"))
    return measures.ranking_measures(o, ["language_code"], "word", [F.desc_nulls_last("selection_count"), F.asc("sense_id")], "rel")


@R.query("""WITH w AS (SELECT concept_slug, id, weight FROM (SELECT source_concept_slug AS concept_slug, id, weight FROM concept_relationships WHERE weight IS NOT NULL)), g AS (SELECT concept_slug, row_number() OVER (PARTITION BY concept_slug ORDER BY weight DESC, id) AS p, round(weight - lead(weight) OVER (PARTITION BY concept_slug ORDER BY weight DESC, id), 6) AS gap FROM w)
SELECT concept_slug, gap, p AS after FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concept_slug ORDER BY gap DESC, p) = 1""")
def score_cliff(spark: SparkSession, d: str) -> DataFrame:
    """The largest fall among the weights of a concept's relations."""
    w = table(spark, d, "concept_relationships").filter("weight IS NOT NULL").select(F.col("source_concept_slug").alias("concept_slug"), "id", "weight")
    return measures.cliff(w, ["concept_slug"], "weight", "id")


@R.query("""WITH a AS (SELECT source_slug, word_text, avg(sense_rank) AS m FROM word_senses GROUP BY 1, 2), r AS (SELECT source_slug, word_text, row_number() OVER (PARTITION BY source_slug ORDER BY m, word_text) AS p FROM a WHERE m IS NOT NULL AND word_text IS NOT NULL),
d AS (SELECT word_text, count(*) AS n, max(p) - min(p) AS spread FROM r GROUP BY word_text HAVING count(*) >= 2) SELECT n, count(*) AS n_words, round(avg(spread), 6) AS mean_spread FROM d GROUP BY n""")
def rank_displacement(spark: SparkSession, d: str) -> DataFrame:
    """How far a word's place differs between sources."""
    a = table(spark, d, "word_senses").groupBy("source_slug", "word_text").agg(F.avg("sense_rank").alias("m")).dropna(subset=["m", "word_text"])
    r = places(a, ["source_slug"], ["m", "word_text"], "p")
    s = r.groupBy("word_text").agg(F.count("*").alias("n"), (F.max("p") - F.min("p")).alias("spread")).filter("n >= 2")
    return s.groupBy("n").agg(F.count("*").alias("n_words"), F.round(F.avg("spread"), 6).alias("mean_spread"))


@R.query()
def family_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The largest greedy family among a source's 40 first words. It depends on the order of words, which SQL cannot state step by step; tests compare it with a loop."""
    w = top_per_key(table(spark, d, "word_senses").select("source_slug", "word_text").dropna().distinct(), ["source_slug"], [F.asc("word_text")], 40)
    lists = w.groupBy("source_slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word_text"))), lambda x: x["word_text"]).alias("words"))  # at most 40 words
    sizes = measures.family_heads(F.col("words"))
    return lists.select("source_slug", F.size(sizes).alias("n_families"), F.round(F.array_max(sizes) / F.size("words"), 6).alias("share"))


@R.query("""SELECT relationship_type, id, row_number() OVER (PARTITION BY relationship_type ORDER BY md5(CAST(id AS VARCHAR) || 'seed'), id) AS place FROM concept_relationships QUALIFY place <= 20""", longs=("place",))
def sample_stable(spark: SparkSession, d: str) -> DataFrame:
    """20 relations of each type, drawn by hash: a sampling operator."""
    return measures.stable_sample(table(spark, d, "concept_relationships").select("relationship_type", "id"), ["relationship_type"], "id", 20, "seed").select("relationship_type", "id", "place")


@R.query("""SELECT concept_slug, min(id) AS first_id, count(DISTINCT source_slug) AS n_sources, count(DISTINCT language_code) AS n_languages, epoch_us(max(loaded_at)) AS last_loaded FROM word_senses GROUP BY concept_slug""")
def group_extremes(spark: SparkSession, d: str) -> DataFrame:
    """First id, different sources and languages, and last loading of each concept's words."""
    w = table(spark, d, "word_senses").groupBy("concept_slug", "source_slug", "language_code").agg(F.min("id").alias("i"), F.max("loaded_at").alias("t"))
    at = F.unix_micros(F.max(F.col("t").cast("timestamp")))
    return w.groupBy("concept_slug").agg(F.min("i").alias("first_id"), F.size(F.collect_set("source_slug")).cast("long").alias("n_sources"), F.size(F.collect_set("language_code")).cast("long").alias("n_languages"), at.alias("last_loaded"))


@R.query("""SELECT g.code, count(*) AS n, count(x.romanization) AS n_romanized, round(100.0 * count(x.romanization) / count(*), 2) AS coverage, max(length(x.lemma)) AS longest, count(*) FILTER (WHERE x.raw_entry IS NULL) AS n_bare FROM lexemes x JOIN languages g ON g.id = x.language_id GROUP BY g.code""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of each language's lexemes is filled in."""
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), "code")
    return table(spark, d, "lexemes").join(g, "language_id").groupBy("code").agg(
        F.count("*").alias("n"), F.count("romanization").alias("n_romanized"), F.round(F.lit(100.0) * F.count("romanization") / F.count("*"), 2).alias("coverage"), F.max(F.length("lemma")).cast("long").alias("longest"), F.count_if(F.col("raw_entry").isNull()).alias("n_bare")
    )


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count({c}) AS n_filled FROM {t}" for t, c in (("concepts", "domain"), ("word_senses", "concept_slug"), ("lexemes", "lemma"), ("senses", "definition"), ("documents", "text"))))
def union_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labelled counts of five tables."""
    out = None
    for t, c in (("concepts", "domain"), ("word_senses", "concept_slug"), ("lexemes", "lemma"), ("senses", "definition"), ("documents", "text")):
        part = table(spark, d, t).agg(F.count("*").alias("n_rows"), F.count(c).alias("n_filled")).select(F.lit(t).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@R.query("""SELECT id, slug, label FROM concepts WHERE (label ILIKE '%amber%' OR description ILIKE '%amber%' OR slug ILIKE '%amber%') AND status IN ('active', 'draft')""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that name a word anywhere."""
    hit = F.col("label").ilike("%amber%") | F.col("description").ilike("%amber%") | F.col("slug").ilike("%amber%")
    return table(spark, d, "concepts").filter(hit & F.col("status").isin("active", "draft")).select("id", "slug", "label")


@R.query("""WITH grid AS (SELECT a.a AS hard, b.b AS depth FROM (SELECT unnest([0.0, 0.25]) AS a) a, (SELECT unnest([0.0, 0.08, 0.16]) AS b) b), s AS (SELECT x.language_id, x.normalized_lemma, s.id, len(list_filter(coalesce(s.raw_tags, []), lambda t: t IN ('rare', 'poetic'))) AS n_hard, greatest(len(coalesce(s.raw_glosses, [])) - 1, 0) AS gd, s.sense_index
FROM senses s JOIN lexemes x ON x.id = s.lexeme_id), r AS (SELECT g.hard, g.depth, s.*, row_number() OVER (PARTITION BY g.hard, g.depth, language_id, normalized_lemma ORDER BY round(-g.hard * n_hard - g.depth * gd, 6) DESC, id) AS rk FROM s, grid g)
SELECT round(hard, 2)::DOUBLE AS hard, round(depth, 2)::DOUBLE AS depth, count(*) FILTER (WHERE rk = 1 AND sense_index = 0) AS first_right, count(*) FILTER (WHERE rk = 1) AS n_words FROM r GROUP BY ALL""")
def knob_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How often a word's first sense leads under a grid of six settings, all in one pass: the settings are an array of each row."""
    grid = F.array(*[F.struct(F.lit(h).alias("hard"), F.lit(g).alias("depth")) for h in (0.0, 0.25) for g in (0.0, 0.08, 0.16)])
    tags = F.filter(F.coalesce("raw_tags", F.array().cast("array<string>")), lambda t: F.coalesce(t.isin("rare", "poetic"), F.lit(False)))
    gd = F.greatest(F.size(F.coalesce("raw_glosses", F.array().cast("array<string>"))) - 1, F.lit(0))
    s = table(spark, d, "senses").select("id", "lexeme_id", "sense_index", F.size(tags).alias("n_hard"), gd.alias("gd")).join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "normalized_lemma"), "lexeme_id")
    s = s.select("*", F.explode(grid).alias("g")).select("*", "g.*")
    score = F.round(-F.col("hard") * F.col("n_hard") - F.col("depth") * F.col("gd"), 6)
    # the first of each word and setting by a minimum: no word's senses are sorted
    first = s.groupBy("hard", "depth", "language_id", "normalized_lemma").agg(F.min(F.struct((-score).alias("s"), "id", "sense_index")).alias("f"))
    return first.groupBy("hard", "depth").agg(F.count_if(F.col("f.sense_index") == 0).alias("first_right"), F.count("*").alias("n_words"))
