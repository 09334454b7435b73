"""Queries of merges, checks, repeats and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.keys import slug_key
from lexiweave.operators import merging, validation
from lexiweave.operators.lookup import top_per_key
from lexiweave.plans.registry import Registry
from lexiweave.session import table
from lexiweave.streaming import counters as counting

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _slug(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"


_STATUS, _SURE = (" ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(o)) for o in (merging.STATUS_ORDER, merging.CONFIDENCE_ORDER))
_RANKS = f"CASE review_status {_STATUS} ELSE 3 END, CASE confidence {_SURE} ELSE 3 END"


@R.query(f"""SELECT source_slug, source_locator, min_by(id, ({_RANKS}, id)) AS id, count(*) AS n_rows FROM word_senses GROUP BY source_slug, source_locator""")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Of word senses delivered again, the one to keep."""
    return merging.keep_best(table(spark, d, "word_senses"), ["source_slug", "source_locator"], "id")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Concepts by slug as first and as last delivered: a table before and after."""
    c = table(spark, d, "concepts").select("id", slug_key("slug").alias("slug"), "label", "domain", "status").filter("slug IS NOT NULL")
    best = lambda f: c.groupBy("slug").agg(f(F.struct("id", "label", "domain", "status")).alias("b")).select("slug", "b.*")
    return best(F.min).filter("id % 7 <> 0"), best(F.max).filter("id % 5 <> 0")


_HALVES = f"""WITH c AS (SELECT id, {_slug('slug')} AS slug, label, domain, status FROM concepts), o AS (SELECT slug, min(id) AS id FROM c WHERE slug IS NOT NULL GROUP BY 1), n AS (SELECT slug, max(id) AS id FROM c WHERE slug IS NOT NULL GROUP BY 1),
old AS (SELECT c.* FROM o JOIN c USING (id) WHERE id % 7 <> 0), new AS (SELECT c.* FROM n JOIN c USING (id) WHERE id % 5 <> 0)"""


@R.query(f"""{_HALVES} SELECT coalesce(o.slug, n.slug) AS slug, CASE WHEN o.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'removed' WHEN o.label IS NOT DISTINCT FROM n.label AND o.domain IS NOT DISTINCT FROM n.domain AND o.status IS NOT DISTINCT FROM n.status THEN 'same' ELSE 'changed' END AS outcome FROM old o FULL JOIN new n ON o.slug = n.slug""")
def capture_diff(spark: SparkSession, d: str) -> DataFrame:
    """What became of each concept between two deliveries."""
    old, new = _halves(spark, d)
    return merging.differences(old, new, ["slug"], ["label", "domain", "status"])


@R.query(f"""{_HALVES}, x AS (SELECT CASE WHEN o.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'removed' WHEN o.label IS NOT DISTINCT FROM n.label AND o.domain IS NOT DISTINCT FROM n.domain THEN 'same' ELSE 'changed' END AS outcome FROM old o FULL JOIN new n ON o.slug = n.slug) SELECT outcome, count(*) AS n FROM x GROUP BY outcome""")
def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """What a merge would do: a dry run."""
    old, new = _halves(spark, d)
    return merging.merge_counts(old, new, ["slug"], ["label", "domain"])


@R.query(f"""{_HALVES} SELECT coalesce(n.slug, o.slug) AS slug, CASE WHEN n.slug IS NOT NULL THEN n.id ELSE o.id END AS id, CASE WHEN n.slug IS NOT NULL THEN n.label ELSE o.label END AS label, CASE WHEN n.slug IS NOT NULL THEN n.domain ELSE o.domain END AS domain, CASE WHEN n.slug IS NOT NULL THEN n.status ELSE o.status END AS status FROM old o FULL JOIN new n ON o.slug = n.slug""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with every column of the newest delivery."""
    old, new = _halves(spark, d)
    return merging.upsert(old, new, ["slug"], [F.desc("id")])


@R.query(f"""{_HALVES} SELECT * FROM old UNION ALL BY NAME SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.slug = n.slug)""")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with what it lacks; incumbents stay."""
    old, new = _halves(spark, d)
    return merging.insert_missing(old, new, ["slug"])


@R.query(f"""{_HALVES} SELECT coalesce(o.slug, n.slug) AS slug, coalesce(o.label, n.label) AS label, coalesce(o.domain, n.domain) AS domain FROM old o FULL JOIN new n ON o.slug = n.slug""")
def repair_merge(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with its gaps filled from a new delivery."""
    old, new = _halves(spark, d)
    return merging.fill_missing(old, new, ["slug"], ["label", "domain"])


@R.query(f"""{_HALVES}, u AS (SELECT * FROM new WHERE status = 'active') SELECT slug, id, label FROM old UNION ALL SELECT slug, id, label FROM u WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.slug = u.slug)""")
def catalogue_export(spark: SparkSession, d: str) -> DataFrame:
    """The base catalogue with accepted new concepts behind it."""
    old, new = _halves(spark, d)
    return merging.append_unseen(old.select("slug", "id", "label"), new, ["slug"], F.col("status") == "active")


@R.query(r"""WITH k AS (SELECT id, language_id, normalized_lemma AS old_key, regexp_replace(lower(lemma), '[-\s]', '', 'g') AS new_key FROM lexemes WHERE lemma IS NOT NULL),
r AS (SELECT id, old_key, new_key, row_number() OVER (PARTITION BY language_id, new_key ORDER BY coalesce(old_key <> new_key, true), id) AS p FROM k)
SELECT id, CASE WHEN p > 1 THEN 'collapse' WHEN old_key IS NOT DISTINCT FROM new_key THEN 'same' ELSE 'update' END AS action FROM r""")
def key_backfill(spark: SparkSession, d: str) -> DataFrame:
    """What a new policy of keys would do to each lexeme."""
    rows = table(spark, d, "lexemes").filter("lemma IS NOT NULL").select("id", "language_id", F.col("normalized_lemma").alias("old_key"), F.regexp_replace(F.lower("lemma"), r"[-\s]", "").alias("new_key"))
    return merging.rekeyed(rows, ["language_id"], "old_key", "new_key", "id", rows.count())


@R.query("""SELECT id, problem FROM (SELECT id, unnest([CASE WHEN regexp_replace(coalesce(concept_slug, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') = '' THEN 'concept_slug: missing' END, CASE WHEN confidence NOT IN ('high', 'medium') THEN 'confidence: not allowed' END,
CASE WHEN sense_rank < 1 OR sense_rank > 5 THEN 'sense_rank: out of range' END]) AS problem FROM word_senses) WHERE problem IS NOT NULL""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with word senses, one row a problem."""
    checks = [validation.required("concept_slug"), validation.one_of("confidence", ("high", "medium")), validation.within("sense_rank", 1, 5)]
    return validation.violations(table(spark, d, "word_senses"), "id", checks)


@R.query("SELECT source_slug, source_locator, count(*) AS n FROM word_senses GROUP BY source_slug, source_locator HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Natural keys that more than one row has."""
    return validation.repeated_keys(table(spark, d, "word_senses"), ["source_slug", "source_locator"])


@R.query("""WITH p AS (SELECT w.id, w.language_code, w.sense_rank, w.gloss FROM word_senses w WHERE w.review_status = 'unreviewed' AND w.gloss <> '' AND EXISTS (SELECT 1 FROM concepts c WHERE c.slug = w.concept_slug AND c.status = 'active'))
SELECT id, language_code, row_number() OVER (PARTITION BY language_code ORDER BY sense_rank DESC NULLS LAST, id) AS place FROM p QUALIFY place <= 200""", longs=("place",))
def batch_preview(spark: SparkSession, d: str) -> DataFrame:
    """The next 200 rows to look at in each language, by priority."""
    c = table(spark, d, "concepts").filter("status = 'active'").select(F.col("slug").alias("concept_slug"))
    w = table(spark, d, "word_senses").filter("review_status = 'unreviewed' AND gloss <> ''").join(c, "concept_slug", "left_semi")
    return top_per_key(w, ["language_code"], [F.desc_nulls_last("sense_rank"), F.asc("id")], 200, "place").select("id", "language_code", "place")


@R.query("""SELECT s.id AS sense_id, coalesce(o.pinned_rank, 0) AS pinned_rank, coalesce(o.is_hidden, s.visibility_status = 'hidden') AS hidden, CASE WHEN coalesce(o.is_hidden, false) THEN 'hidden' ELSE s.visibility_status END AS visibility FROM senses s LEFT JOIN sense_options o ON o.sense_id = s.id""")
def admin_override(spark: SparkSession, d: str) -> DataFrame:
    """Senses with their overrides merged in."""
    o = table(spark, d, "sense_options").select("sense_id", "pinned_rank", "is_hidden")
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "visibility_status").join(o, "sense_id", "left")
    return s.select(
        "sense_id",
        F.coalesce("pinned_rank", F.lit(0)).alias("pinned_rank"),
        F.coalesce("is_hidden", F.col("visibility_status") == "hidden").alias("hidden"),
        F.when(F.coalesce("is_hidden", F.lit(False)), "hidden").otherwise(F.col("visibility_status")).alias("visibility"),
    )


@R.query("SELECT user_id, event_type, count(*) AS n, epoch_us(max(ts)) AS last_at FROM events GROUP BY user_id, event_type")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and kind with their last time."""
    return counting.count_events(table(spark, d, "events"), ["user_id", "event_type"]).withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


@R.query("SELECT lower(event_type) AS word, count(DISTINCT user_id) AS n, epoch_us(max(ts)) AS last_at FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def word_counters(spark: SparkSession, d: str) -> DataFrame:
    """Words counted once a request; users stand in for requests."""
    return counting.count_words(table(spark, d, "events"), "user_id", "event_type").withColumn("last_at", F.unix_micros(F.col("last_at").cast("timestamp")))


@R.query("SELECT c.id AS user_id, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT user_id + 500 AS id FROM events) c LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) n ON n.user_id = c.id")
def counter_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Counters of wanted users, those without events too."""
    e = table(spark, d, "events")
    return counting.counters_of(counting.count_events(e, ["user_id"]), e.select((F.col("user_id") + 500).alias("user_id")), ["user_id"]).select("user_id", "n")


@R.query("SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and kind."""
    return counting.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "1 hour", ["event_type"]).withColumn("start", F.unix_micros("start"))


@R.query(r"""SELECT doc_id, regexp_extract(text, '(?s)<p>(.*?)</p>', 1) AS inner_text, len(regexp_extract_all(text, '</?[A-Za-z][^<>]*>')) AS n_tags, regexp_replace(text, '</?[A-Za-z][^<>]*>', '', 'g') AS plain FROM documents WHERE contains(text, '<')""", longs=("n_tags",))
def html_scan(spark: SparkSession, d: str) -> DataFrame:
    """Marked-up documents with their tags counted and taken off."""
    tag = r"</?[A-Za-z][^<>]*>"
    return table(spark, d, "documents").filter(F.contains("text", F.lit("<"))).select(
        "doc_id", F.regexp_extract("text", r"(?s)<p>(.*?)</p>", 1).alias("inner_text"), F.size(F.regexp_extract_all("text", F.lit(tag), F.lit(0))).alias("n_tags"), F.regexp_replace("text", tag, "").alias("plain")
    )


@R.query(r"""WITH c AS (SELECT id AS sense_id, unnest(categories) AS c FROM senses) SELECT sense_id, coalesce(nullif(regexp_extract(c, '''name'': ''([^'']*)''', 1), ''), nullif(regexp_extract(c, '''name'': "([^"]*)"', 1), '')) AS category, nullif(regexp_extract(c, '''kind'': ''([^'']*)''', 1), '') AS kind FROM c WHERE c IS NOT NULL""")
def category_parse(spark: SparkSession, d: str) -> DataFrame:
    """Names and kinds out of printed dictionaries, quoted either way."""
    c = table(spark, d, "senses").select(F.col("id").alias("sense_id"), F.explode("categories").alias("c")).filter("c IS NOT NULL")
    pick = lambda p: F.nullif(F.regexp_extract("c", p, 1), F.lit(""))
    return c.select("sense_id", F.coalesce(pick("'name': '([^']*)'"), pick("'name': \"([^\"]*)\"")).alias("category"), pick("'kind': '([^']*)'").alias("kind"))


@R.query(r"""SELECT row_id, CASE WHEN regexp_matches(coalesce(synonyms, ''), '[a-z]-[a-z]') THEN 'compound' WHEN regexp_matches(coalesce(definition, ''), '^(a|an|the) ') THEN 'phrase' WHEN definition IS NULL OR definition = '' THEN 'empty' ELSE 'other' END AS reason,
CASE WHEN review_status = 'needs_review' THEN 3 WHEN TRY_CAST(extraction_confidence AS DOUBLE) < 0.9 THEN 2 ELSE 1 END AS priority, CASE WHEN TRY_CAST(extraction_confidence AS DOUBLE) >= 0.9 THEN 'high' WHEN TRY_CAST(extraction_confidence AS DOUBLE) >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM raw_entries""")
def preclassify(spark: SparkSession, d: str) -> DataFrame:
    """Why and how urgently an extracted entry is to be looked at, and how sure it is."""
    sure = F.expr("try_cast(extraction_confidence AS double)")
    reason = F.when(F.coalesce("synonyms", F.lit("")).rlike("[a-z]-[a-z]"), "compound").when(F.coalesce("definition", F.lit("")).rlike("^(a|an|the) "), "phrase").when(F.coalesce("definition", F.lit("")) == "", "empty").otherwise("other")
    return table(spark, d, "raw_entries").select(
        "row_id", reason.alias("reason"), F.when(F.col("review_status") == "needs_review", 3).when(sure < 0.9, 2).otherwise(1).alias("priority"), F.when(sure >= 0.9, "high").when(sure >= 0.7, "medium").otherwise("low").alias("band")
    )


@R.query("""SELECT s.id, x.id AS lexeme_id FROM senses s LEFT JOIN lexemes x ON x.id = s.lexeme_id AND x.import_status = 'active' WHERE s.lexeme_id IS NULL OR x.id IS NOT NULL""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Senses that stay when retired lexemes go."""
    s = merging.cascade(table(spark, d, "lexemes").filter("import_status = 'active'"), table(spark, d, "senses").select("id", "lexeme_id"), "id", "lexeme_id")
    return s.select("id", "lexeme_id")
