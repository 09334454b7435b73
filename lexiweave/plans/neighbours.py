"""Queries of nearest neighbours, their reranking and the filters around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions import fixed
from lexiweave.functions.keys import trimmed
from lexiweave.operators import measures, vector_index, vectors
from lexiweave.operators.lookup import top_per_key
from lexiweave.plans.graphs import _nested, _nested_sql, same_stem_sql
from lexiweave.plans.registry import Registry
from lexiweave.session import table
from lexiweave.skew import hot_keys, salted_join

R = Registry()
QUERIES, SQL = R.queries, R.sql
#: The stated queries of a search: every row whose id is divisible by this.
EVERY = 100


def sense_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Visible senses with a vector: (id, vector, language, lexeme_id, word, definition, n_selected)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    s = table(spark, d, "senses").filter("visibility_status = 'visible'").select("id", "lexeme_id", "definition")
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", F.lower("normalized_lemma").alias("word"))
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("code").alias("language"))
    o = table(spark, d, "sense_options").select(F.col("sense_id").alias("id"), F.coalesce("selection_count", F.lit(0)).alias("n_selected"))
    return v.join(s, "id").join(x, "lexeme_id").join(g, "language_id").join(o, "id", "left").na.fill(0, ["n_selected"]).drop("language_id")


_VECTORS = """WITH sv AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS vector, s.lexeme_id, s.definition, lower(x.normalized_lemma) AS word, g.code AS language, coalesce(o.selection_count, 0) AS n_selected
  FROM embeddings e JOIN senses s ON s.id = e.vec_id AND s.visibility_status = 'visible' JOIN lexemes x ON x.id = s.lexeme_id JOIN languages g ON g.id = x.language_id LEFT JOIN sense_options o ON o.sense_id = s.id)"""


def _pairs(scoped: bool = True, apart: str = "lexeme_id") -> str:
    scope = "AND q.language = r.language" if scoped else ""
    return f"""sims AS (SELECT q.id AS query_id, r.id AS row_id, round(list_cosine_similarity(q.vector, r.vector), 6) + 0.0 AS sim FROM sv q JOIN sv r ON q.{apart} <> r.{apart} {scope} WHERE q.id % {EVERY} = 0)"""


def _top(k: int, src: str = "sims") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, row_id) AS place FROM {src} QUALIFY place <= {k})"


def _search(spark: SparkSession, d: str, k: int, scope: str | None = "language", apart: str = "lexeme_id") -> tuple[DataFrame, DataFrame]:
    sv = sense_vectors(spark, d)
    return sv, vectors.nearest(sv.filter(F.col("id") % EVERY == 0), sv, k, scope, apart)


@R.query(f"{_VECTORS}, {_pairs()} SELECT query_id, row_id, sim FROM {_top(10)}")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The 10 senses nearest to each query sense in its language, without those of its own lexeme."""
    return _search(spark, d, 10)[1]


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_RERANK = f"""{_VECTORS}, {_pairs()}, opposites AS (SELECT n.sense_id AS query_id, lower(regexp_replace(o ->> 'word', '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS word FROM ({_nested_sql('antonyms')}) n),
near AS (SELECT n.query_id, n.row_id, n.sim, c.word, coalesce(c.definition, '') AS definition, c.n_selected FROM {_top(500)} n JOIN sv c ON c.id = n.row_id JOIN sv q ON q.id = n.query_id
  WHERE n.place <= CASE WHEN q.language = 'en' THEN 500 ELSE 200 END AND NOT coalesce({same_stem_sql('q.word', 'c.word')}, false) AND NOT EXISTS (SELECT 1 FROM opposites a WHERE a.query_id = n.query_id AND a.word = c.word)),
words AS (SELECT * FROM near WHERE length(word) BETWEEN 3 AND 18 QUALIFY row_number() OVER (PARTITION BY query_id, word ORDER BY n_selected DESC, sim DESC, row_id) = 1),
half AS (SELECT *, n_selected > 0 AND row_number() OVER (PARTITION BY query_id ORDER BY n_selected DESC, row_id) <= greatest(1, (count(*) FILTER (WHERE n_selected > 0) OVER (PARTITION BY query_id) + 1) // 2) AS popular FROM words),
judged AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(definition), '[a-z][a-z''-]{{2,}}'), lambda t: NOT list_contains({_list(fixed.STOPWORDS)}, t))) AS terms FROM half),
scored AS (SELECT *, round(sim + CASE WHEN popular THEN 0.025 ELSE 0 END + CASE WHEN trim(definition) = '' THEN -0.08 WHEN list_bool_or(list_transform({_list(fixed.GENERIC_PREFIXES)}, lambda p: starts_with(lower(definition), p))) THEN -0.055
  WHEN len(terms) <= 2 THEN -0.04 ELSE 0 END + CASE WHEN list_has_any(terms, {_list(fixed.BROAD_TERMS)}) OR list_bool_or(list_transform({_list(fixed.BROAD_PHRASES)}, lambda p: contains(lower(definition), p))) THEN -0.05 ELSE 0 END, 6) AS score FROM judged)"""


@R.query(f"""{_RERANK} SELECT query_id, row_id, word, sim, popular, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM scored WHERE score >= -0.2) WHERE place <= 10""", longs=("place",))
def knn_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours reranked by what is known about them: no forms of the query's word or antonyms of it, one sense a word, adjusted, cut at a floor, the best 10."""
    most = {g: vectors.fetched(10, g) for g in ("en", None)}
    sv, near = _search(spark, d, max(most.values()))
    near = near.join(sv.select(F.col("id").alias("query_id"), F.col("word").alias("query_word"), "language"), "query_id")
    near = top_per_key(near, ["query_id"], [F.desc("sim"), F.asc("row_id")], max(most.values()), "_p").filter(F.col("_p") <= F.when(F.col("language") == "en", most["en"]).otherwise(most[None]))
    c = near.join(sv.select(F.col("id").alias("row_id"), "word", F.coalesce("definition", F.lit("")).alias("definition"), "n_selected"), "row_id")
    opposite = _nested(spark, d, "antonyms").select(F.col("sense_id").alias("query_id"), F.lower(trimmed("word")).alias("word")).filter(F.col("query_id") % EVERY == 0)
    form = F.coalesce(vectors.same_stem(F.col("query_word"), F.col("word")), F.lit(False))  # a query without a word has no forms
    c = c.filter(F.length("word").between(3, 18)).filter(~form).join(opposite, ["query_id", "word"], "left_anti")
    c = vectors.best_per_word(c, ["query_id", "word"], [F.desc("n_selected"), F.desc("sim"), F.asc("row_id")])
    c = c.withColumn("popular", vectors.popular_half(c, "query_id", "n_selected", "row_id"))
    text = F.lower("definition")
    c = c.withColumn("terms", F.array_distinct(F.array_except(F.regexp_extract_all(text, F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0)), F.array(*map(F.lit, fixed.STOPWORDS)))))
    starts = lambda ps, f: F.exists(F.array(*map(F.lit, ps)), lambda p: f(text, p))
    broad = F.arrays_overlap("terms", F.array(*map(F.lit, fixed.BROAD_TERMS))) | starts(fixed.BROAD_PHRASES, F.contains)
    c = c.withColumn("score", vectors.rerank_score(F.col("sim"), F.col("popular"), F.col("definition"), F.size("terms"), starts(fixed.GENERIC_PREFIXES, F.startswith), broad))
    return top_per_key(c.filter("score >= -0.2"), ["query_id"], [F.desc("score"), F.asc("row_id")], 10, "place").select("query_id", "row_id", "word", "sim", "popular", "score", "place")


@R.query(f"""{_VECTORS}, {_pairs()}, floors AS (SELECT unnest({_list(tuple(fixed.FALLBACK_FLOORS))}) AS language, unnest({list(fixed.FALLBACK_FLOORS.values())}) - 0.7 AS floor)
SELECT n.query_id, n.row_id, n.sim FROM {_top(1)} n JOIN sv q ON q.id = n.query_id JOIN floors f ON f.language = q.language WHERE n.sim >= f.floor""")
def vector_rung(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sense above its language's floor; a language without a floor finds none. The floors lie 0.7 lower here, as the vectors of the data are random."""
    sv, near = _search(spark, d, 1)
    floors = spark.createDataFrame([(g, round(f - 0.7, 6)) for g, f in fixed.FALLBACK_FLOORS.items()], "language string, floor double")
    return near.join(sv.select(F.col("id").alias("query_id"), "language"), "query_id").join(F.broadcast(floors), "language").filter("sim >= floor").select("query_id", "row_id", "sim")


@R.query(f"""{_VECTORS}, {_pairs()}, floors AS (SELECT unnest({_list(tuple(fixed.KNN_FLOORS))}) AS language, unnest({list(fixed.KNN_FLOORS.values())}) AS floor),
j AS (SELECT n.*, q.language, coalesce(f.floor, 0.78) - 0.7 AS floor FROM {_top(20)} n JOIN sv q ON q.id = n.query_id LEFT JOIN floors f ON f.language = q.language)
SELECT query_id, count(*) AS n_found, count(*) FILTER (WHERE sim >= floor) AS n_kept FROM j GROUP BY query_id""")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    """How many of 20 neighbours stay above the floor of their language."""
    sv, near = _search(spark, d, 20)
    floors = spark.createDataFrame(list(fixed.KNN_FLOORS.items()), "language string, floor double")
    j = near.join(sv.select(F.col("id").alias("query_id"), "language"), "query_id").join(F.broadcast(floors), "language", "left")
    kept = F.col("sim") >= F.round(F.coalesce("floor", F.lit(fixed.KNN_FLOOR)) - 0.7, 6)
    return j.groupBy("query_id").agg(F.count("*").alias("n_found"), F.count_if(kept).alias("n_kept"))


@R.query(f"""{_VECTORS}, {_pairs(False, "id")} SELECT q.language, c.language AS found_language, count(*) AS n FROM {_top(15)} n JOIN sv q ON q.id = n.query_id JOIN sv c ON c.id = n.row_id GROUP BY ALL""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Which languages the 15 nearest of all senses are of."""
    sv, near = _search(spark, d, 15, None, "id")
    tag = lambda i, g: sv.select(F.col("id").alias(i), F.col("language").alias(g))
    return near.join(tag("query_id", "language"), "query_id").join(tag("row_id", "found_language"), "row_id").groupBy("language", "found_language").agg(F.count("*").alias("n"))


def _stem_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN length({c}) > {len(s) + 2} AND ends_with({c}, '{s}') THEN left({c}, length({c}) - {len(s)})" for s in fixed.SUFFIXES) + f" ELSE {c} END"


@R.query(f"""WITH w AS (SELECT DISTINCT lower(lemma) AS word, left(lower(lemma), 5) AS head FROM lexemes WHERE length(lemma) >= 5), s AS (SELECT *, {_stem_sql('word')} AS stem FROM w),
q AS (SELECT DISTINCT lower(lemma) AS word FROM lexemes WHERE length(lemma) >= 5 AND id % {EVERY} = 0)
SELECT a.word AS word, b.word AS variant FROM s a JOIN q ON q.word = a.word JOIN s b ON a.head = b.head AND a.word <> b.word
WHERE a.stem = b.stem OR (least(length(a.stem), length(b.stem)) >= 5 AND left(a.stem, greatest(5, least(length(a.stem), length(b.stem)) - 1)) = left(b.stem, greatest(5, least(length(a.stem), length(b.stem)) - 1)))""")
def morph_reject(spark: SparkSession, d: str) -> DataFrame:
    """Words of five letters or more that are forms of the word of every hundredth lexeme, among those that begin alike."""
    x = table(spark, d, "lexemes").filter(F.length("lemma") >= 5).select(F.lower("lemma").alias("word"), F.left(F.lower("lemma"), F.lit(5)).alias("head"), "id")
    q = x.filter(F.col("id") % EVERY == 0).select("word", "head").distinct()
    w = x.select(F.col("word").alias("variant"), "head").distinct()
    return salted_join(w, q, "head", hot_keys(w, "head", x.count()), "variant").filter("word <> variant").filter(vectors.same_stem(F.col("word"), F.col("variant"))).select("word", "variant")


@R.query(f"""{_VECTORS}, {_pairs()}, opposites AS (SELECT n.sense_id AS query_id, lower(regexp_replace(o ->> 'word', '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS word FROM ({_nested_sql('antonyms')}) n)
SELECT n.query_id, n.row_id FROM {_top(30)} n JOIN sv c ON c.id = n.row_id WHERE NOT EXISTS (SELECT 1 FROM opposites x WHERE x.query_id = n.query_id AND x.word = c.word)""")
def antonym_anti(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours without those whose word the query's sense names as its opposite."""
    sv, near = _search(spark, d, 30)
    out = _nested(spark, d, "antonyms").select(F.col("sense_id").alias("query_id"), F.lower(trimmed("word")).alias("word"))
    return near.join(sv.select(F.col("id").alias("row_id"), "word"), "row_id").join(out, ["query_id", "word"], "left_anti").select("query_id", "row_id")


@R.query("""SELECT id, lemma, length(lemma) AS n_chars, length(regexp_replace(lemma, '[-\\s'']', '', 'g')) AS n_letters FROM lexemes WHERE length(lemma) BETWEEN 4 AND 9 AND length(regexp_replace(lemma, '[-\\s'']', '', 'g')) >= 4""", longs=("n_chars", "n_letters"))
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words of 4 to 9 characters with 4 letters or more."""
    n = F.length(F.regexp_replace("lemma", r"[-\s']", ""))
    return table(spark, d, "lexemes").select("id", "lemma", F.length("lemma").alias("n_chars"), n.alias("n_letters")).filter("n_chars BETWEEN 4 AND 9 AND n_letters >= 4")


@R.query(f"""WITH t AS (SELECT s.id AS sense_id, list_distinct(regexp_extract_all(lower(coalesce(s.definition, '')), '[\\p{{L}}\\p{{N}}]+')) AS tokens, list_distinct(regexp_extract_all(lower(coalesce(x.lemma, '')), '[\\p{{L}}\\p{{N}}]+')) AS lemma_tokens FROM senses s JOIN lexemes x ON x.id = s.lexeme_id)
SELECT sense_id, list_has_any(tokens, {_list((*fixed.HEDGES, 'dated', 'trade'))}) AS hedged, len(lemma_tokens) > 0 AND list_has_all(tokens, lemma_tokens) AS names_itself, len(list_filter(tokens, lambda t: NOT list_contains({_list(fixed.STOPWORDS)}, t))) AS n_terms FROM t""", longs=("n_terms",))
def hedge_and_subset(spark: SparkSession, d: str) -> DataFrame:
    """Whether a definition hedges, whether it holds all of its word, and its terms."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", words("definition").alias("tokens"))
    j = s.join(table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), words("lemma").alias("lemma_tokens")), "lexeme_id")
    return j.select(
        "sense_id",
        F.arrays_overlap("tokens", F.array(*map(F.lit, (*fixed.HEDGES, "dated", "trade")))).alias("hedged"),
        ((F.size("lemma_tokens") > 0) & (F.size(F.array_except("lemma_tokens", "tokens")) == 0)).alias("names_itself"),
        F.size(F.array_except("tokens", F.array(*map(F.lit, fixed.STOPWORDS)))).alias("n_terms"),
    )


@R.query(f"""{_VECTORS}, {_pairs()}, j AS (SELECT n.query_id, n.row_id, n.sim, list_has_any(list_distinct(regexp_extract_all(lower(coalesce(q.definition, '')), '[\\p{{L}}\\p{{N}}]+')), {_list(fixed.HEDGES)}) AS hedged,
  list_distinct(regexp_extract_all(lower(coalesce(c.definition, '')), '[\\p{{L}}\\p{{N}}]+')) AS tokens, list_distinct(regexp_extract_all(q.word, '[\\p{{L}}\\p{{N}}]+')) AS own FROM {_top(5)} n JOIN sv q ON q.id = n.query_id JOIN sv c ON c.id = n.row_id),
e AS (SELECT query_id, row_id, round(sim + CASE WHEN len(own) > 0 AND list_has_all(tokens, own) AND NOT hedged THEN 0.02 ELSE 0 END, 6) AS effective FROM j)
SELECT query_id, row_id, effective FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY effective DESC, row_id) = 1""")
def display_bonus(spark: SparkSession, d: str) -> DataFrame:
    """The display sense among the 5 nearest: a definition that holds the query's word counts more, unless the query hedges."""
    sv, near = _search(spark, d, 5)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    q = sv.select(F.col("id").alias("query_id"), words("word").alias("own"), F.arrays_overlap(words("definition"), F.array(*map(F.lit, fixed.HEDGES))).alias("hedged"))
    j = near.join(q, "query_id").join(sv.select(F.col("id").alias("row_id"), words("definition").alias("tokens")), "row_id")
    bonus = F.when((F.size("own") > 0) & (F.size(F.array_except("own", "tokens")) == 0) & ~F.col("hedged"), 0.02).otherwise(0.0)
    return vectors.best_per_word(j.withColumn("effective", F.round(F.col("sim") + bonus, 6)), ["query_id"], [F.desc("effective"), F.asc("row_id")]).select("query_id", "row_id", "effective")


_CALIBRATED = f"""{_VECTORS}, f AS (SELECT lexeme_id, min(id) AS id FROM sv GROUP BY 1), p AS (SELECT s.id, round(list_cosine_similarity(s.vector, h.vector), 6) AS sim FROM sv s JOIN f ON f.lexeme_id = s.lexeme_id JOIN sv h ON h.id = f.id WHERE s.id <> h.id),
r AS (SELECT s.id, round(list_cosine_similarity(s.vector, o.vector), 6) AS sim FROM sv s JOIN sv o ON o.id = s.id + 1)"""
_KINDS = ("same", "random")


def likenesses(spark: SparkSession, d: str) -> DataFrame:
    """(kind, sim): likenesses of a lexeme's senses to its first one, and of senses to unrelated ones."""
    sv = sense_vectors(spark, d).select("id", "lexeme_id", "vector")
    first = sv.groupBy("lexeme_id").agg(F.min(F.struct("id", "vector")).alias("h")).select("lexeme_id", F.col("h.id").alias("hid"), F.col("h.vector").alias("other"))
    same = sv.join(first, "lexeme_id").filter("id <> hid").select(F.lit("same").alias("kind"), "vector", "other")
    rand = sv.join(sv.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id").select(F.lit("random").alias("kind"), "vector", "other")
    return same.unionByName(rand).select("kind", F.round(vectors.cosine(F.col("vector"), F.col("other")), 6).alias("sim"))


@R.query(f"""{_CALIBRATED}
SELECT 'same' AS kind, count(*) AS n, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.99), 6) AS p99 FROM p UNION ALL SELECT 'random', count(*), round(quantile_cont(sim, 0.1), 6), round(quantile_cont(sim, 0.5), 6), round(quantile_cont(sim, 0.99), 6) FROM r""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of both kinds of likenesses: what floors are set by. A kind without any has none."""
    sims = likenesses(spark, d)
    q = measures.quantiles(sims, ["kind"], "sim", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).drop("n")
    n = sims.groupBy("kind").agg(F.count("*").alias("n"))  # those of vectors without length, too
    kinds = spark.createDataFrame([(k,) for k in _KINDS], "kind string")
    return kinds.join(n, "kind", "left").join(q, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@R.query(f"""{_CALIBRATED}, q AS (SELECT unnest([0.1, 0.5, 0.9]) AS point, unnest(quantile_cont(sim, [0.1, 0.5, 0.9])) AS bound FROM p)
SELECT q.point, round(q.bound, 6) AS bound, round((SELECT avg((r.sim >= q.bound)::INTEGER) FROM r WHERE sim IS NOT NULL), 6) AS random_share FROM q WHERE q.bound IS NOT NULL""")
def mass_above(spark: SparkSession, d: str) -> DataFrame:
    """The share of unrelated senses that lie above a quantile of related ones."""
    sims = likenesses(spark, d)
    points = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    same = measures.quantiles(sims.filter("kind = 'same'"), ["kind"], "sim", points)
    counts = sims.filter("kind = 'random' AND sim IS NOT NULL").groupBy("sim").agg(F.count("*").alias("n")).withColumn("kind", F.lit("same"))
    shares = [F.round(F.sum(F.when(F.col("sim") >= F.col(c), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias(f"s_{c}") for c in points]
    one = same.join(counts.join(F.broadcast(same.drop("n")), "kind").groupBy("kind").agg(*shares), "kind", "left")  # a row at most
    rows = F.array(*[F.struct(F.lit(q).alias("point"), F.round(c, 6).alias("bound"), F.col(f"s_{c}").alias("random_share")) for c, q in points.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@R.query()
def knn_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """What the index finds of the 10 nearest senses of every query sense, against the exact search."""
    sv = sense_vectors(spark, d).select("id", "vector")
    q, k = sv.filter(F.col("id") % EVERY == 0), 10
    true, index = vectors.nearest(q, sv, k), vector_index.build(sv, k)
    found = vector_index.search(q, index, k).select("query_id", "row_id", F.lit(1).alias("hit"))
    j = true.join(found, ["query_id", "row_id"], "left")
    return j.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), F.round(F.try_divide(F.count("hit"), F.count("*")), 4).alias("recall"), F.lit(len(index.centres)).alias("n_lists"), F.lit(index.probes).alias("n_probed")).filter("n_true > 0")
