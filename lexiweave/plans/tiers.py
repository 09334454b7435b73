"""Queries of tiers, characters and canonical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions import fixed, romanize, unicode_keys
from lexiweave.operators import taxonomy
from lexiweave.plans.registry import Registry
from lexiweave.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def sense_rows(spark: SparkSession, d: str) -> DataFrame:
    """Senses with the parts the rules read."""
    s = table(spark, d, "senses").select(F.col("id").alias("sense_id"), "lexeme_id", "definition", "raw_tags", "visibility_status")
    x = table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id"), "language_id", "lemma", "normalized_lemma", "part_of_speech")
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("code").alias("language_code"))
    return s.join(x, "lexeme_id").join(g, "language_id")


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_TRIM = r"regexp_replace(coalesce({0}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _rules(tags: str) -> str:
    # RE2 knows the same classes of characters
    return rf"""CASE WHEN length(defn) < 3 THEN 1 WHEN lem = '' THEN 2 WHEN list_contains({_list(fixed.TIER_A_POS)}, pos) THEN 3 WHEN list_has_any({tags}, {_list(fixed.TIER_A_TAGS)}) THEN 4
  WHEN regexp_matches(lem, '\p{{Nd}}') THEN 5 WHEN starts_with(lem, '-') OR ends_with(lem, '-') THEN 6
  WHEN NOT (CASE WHEN language_code IN ('hi', 'sa') THEN regexp_full_match(lem, '[\p{{L}}\p{{Mn}}\p{{Mc}}'' -]*') AND regexp_matches(lem, '\p{{L}}')
    WHEN language_code = 'fa' THEN regexp_full_match(lem, '[\p{{L}}'' \x{{200c}}\x{{200d}}-]*') AND regexp_matches(lem, '\p{{L}}') ELSE regexp_full_match(lem, '[\p{{L}}'' -]*') END) THEN 7
  WHEN regexp_full_match(lem, '[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}]') THEN 8 WHEN pos IN ('name', 'num') THEN 9 WHEN list_has_any({tags}, {_list(fixed.TIER_B_TAGS)}) THEN 10 WHEN contains(lem, ' ') THEN 11
  WHEN coalesce(language_code, '') <> 'de' AND regexp_matches(lem, '^\p{{Lu}}') AND lem <> upper(lem) THEN 12 ELSE 13 END"""


_TIERS = rf"""WITH base AS (SELECT s.id AS sense_id, s.visibility_status, g.code AS language_code, x.normalized_lemma, x.language_id, x.id AS lexeme_id, lower({_TRIM.format('x.part_of_speech')}) AS pos, {_TRIM.format('x.lemma')} AS lem, {_TRIM.format('s.definition')} AS defn,
  list_filter(list_transform(coalesce(s.raw_tags, []), lambda t: lower({_TRIM.format('t')})), lambda t: t <> '') AS tags FROM senses s JOIN lexemes x ON x.id = s.lexeme_id JOIN languages g ON g.id = x.language_id),
ruled AS (SELECT *, {_rules('tags')} AS rule, {_rules(f"list_filter(tags, lambda t: NOT list_contains({_list(fixed.ALT_TAGS)}, t))")} AS less FROM base),
tiers AS (SELECT *, CASE WHEN rule <= 8 THEN 'A' WHEN rule <= 12 THEN 'B' ELSE 'C' END AS tier, rule <= 8 AND less > 8 AND list_has_any(tags, {_list(fixed.ALT_TAGS)}) AS sole_alt FROM ruled)"""


@R.query(f"{_TIERS} SELECT sense_id, rule, tier, sole_alt FROM tiers")
def tier_classify(spark: SparkSession, d: str) -> DataFrame:
    """Rule and tier of every sense."""
    return taxonomy.classify(sense_rows(spark, d)).select("sense_id", "rule", "tier", "sole_alt")


@R.query(f"""{_TIERS} SELECT language_code, count(*) FILTER (WHERE tier = 'A') AS "A", count(*) FILTER (WHERE tier = 'B') AS "B", count(*) FILTER (WHERE tier = 'C') AS "C", count(*) FILTER (WHERE visibility_status = 'visible') AS n_visible FROM tiers GROUP BY language_code""")
def tier_census(spark: SparkSession, d: str) -> DataFrame:
    """Senses by language and tier."""
    c = taxonomy.classify(sense_rows(spark, d))
    return c.groupBy("language_code").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in "ABC"], F.count_if(F.col("visibility_status") == "visible").alias("n_visible"))


@R.query(f"""{_TIERS} SELECT tier AS from_tier, CASE WHEN less <= 8 THEN 'A' WHEN less <= 12 THEN 'B' ELSE 'C' END AS to_tier, count(*) AS n FROM (SELECT tier, {_rules("[]")} AS less FROM tiers) GROUP BY ALL""")
def tier_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How tiers would change if no tag counted."""
    rows = sense_rows(spark, d)
    return taxonomy.transitions(taxonomy.classify(rows), taxonomy.classify(rows.withColumn("raw_tags", F.array().cast("array<string>"))), "sense_id")


@R.query(f"{_TIERS} SELECT pos, tier, rule, count(*) AS n FROM tiers GROUP BY ALL")
def tier_by_pos(spark: SparkSession, d: str) -> DataFrame:
    """Which rule decided, by part of speech."""
    c = taxonomy.classify(sense_rows(spark, d))
    return c.groupBy(F.lower(F.coalesce("part_of_speech", F.lit(""))).alias("pos"), "tier", "rule").agg(F.count("*").alias("n"))


@R.query(f"""{_TIERS} SELECT sense_id, CASE rule WHEN 1 THEN 'short definition' WHEN 2 THEN 'no lemma' WHEN 3 THEN 'part of speech' WHEN 4 THEN 'tag' WHEN 5 THEN 'digit' WHEN 6 THEN 'hyphen at the edge' WHEN 7 THEN 'odd characters' ELSE 'single letter' END AS reason FROM tiers WHERE tier = 'A'""")
def purge_reason(spark: SparkSession, d: str) -> DataFrame:
    """Senses to be purged, with the reason."""
    return taxonomy.purge_reasons(taxonomy.classify(sense_rows(spark, d))).select("sense_id", "reason")


@R.query(f"""{_TIERS}, kept AS (SELECT lexeme_id, count(*) AS n_left FROM tiers WHERE tier <> 'A' GROUP BY lexeme_id) SELECT x.id AS lexeme_id, coalesce(k.n_left, 0) AS n_left FROM lexemes x LEFT JOIN kept k ON k.lexeme_id = x.id""")
def purge_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Senses left to each lexeme once tier A is gone; lexemes with none go with them."""
    kept = taxonomy.classify(sense_rows(spark, d)).filter("tier <> 'A'").groupBy("lexeme_id").agg(F.count("*").alias("n_left"))
    return table(spark, d, "lexemes").select(F.col("id").alias("lexeme_id")).join(kept, "lexeme_id", "left").na.fill(0)


@R.query(f"""{_TIERS} SELECT CASE WHEN sole_alt THEN 'provisional' WHEN tier = 'A' THEN 'dropped' WHEN tier = 'B' THEN 'hidden' ELSE 'visible' END AS outcome, count(*) AS n_senses, count(DISTINCT lexeme_id) AS n_lexemes FROM tiers GROUP BY outcome""")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What an import does with each sense."""
    outcome = F.when(F.col("sole_alt"), "provisional").when(F.col("tier") == "A", "dropped").when(F.col("tier") == "B", "hidden").otherwise("visible")
    return taxonomy.classify(sense_rows(spark, d)).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_senses"), F.countDistinct("lexeme_id").alias("n_lexemes"))


@R.query(r"""WITH c AS (SELECT language_id, unnest(string_split(lemma, '')) AS ch FROM lexemes WHERE lemma IS NOT NULL AND lemma <> '')
SELECT language_id, CASE WHEN regexp_full_match(ch, '\p{L}') THEN 'letter' WHEN regexp_full_match(ch, '\p{M}') THEN 'mark' WHEN regexp_full_match(ch, '\p{N}') THEN 'number' WHEN regexp_full_match(ch, '\p{P}') THEN 'punctuation' WHEN regexp_full_match(ch, '\p{Z}') THEN 'space' ELSE 'other' END AS kind,
  count(*) AS n, count(DISTINCT ch) AS n_distinct FROM c GROUP BY ALL""")
def char_census(spark: SparkSession, d: str) -> DataFrame:
    """Characters of lemmas by language and class."""
    c = table(spark, d, "lexemes").filter("lemma <> ''").select("language_id", F.explode(F.split("lemma", "(?s)(?<=.)")).alias("ch")).filter("ch <> ''")
    kind = F.when(F.col("ch").rlike(r"^\p{L}$"), "letter").when(F.col("ch").rlike(r"^\p{M}$"), "mark").when(F.col("ch").rlike(r"^\p{N}$"), "number").when(F.col("ch").rlike(r"^\p{P}$"), "punctuation").when(F.col("ch").rlike(r"^\p{Z}$"), "space").otherwise("other")
    # characters are counted before they are classed, so the shuffle holds each once a task
    per = c.groupBy("language_id", "ch").agg(F.count("*").alias("n"))
    return per.groupBy("language_id", kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


@R.query("""SELECT id, raw_entry ->> 'pos' AS pos, raw_entry ->> 'lang_code' AS lang_code, json_exists(raw_entry, '$.forms') AS has_forms, TRY_CAST(raw_entry ->> 'etymology_number' AS INTEGER) AS etymology_number FROM lexemes WHERE raw_entry IS NOT NULL""")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the raw entries: there or not, and their values."""
    v = F.try_parse_json("raw_entry")
    return table(spark, d, "lexemes").filter("raw_entry IS NOT NULL").select(
        "id",
        F.try_variant_get(v, "$.pos", "string").alias("pos"),
        F.try_variant_get(v, "$.lang_code", "string").alias("lang_code"),
        F.try_variant_get(v, "$.forms", "variant").isNotNull().alias("has_forms"),
        F.try_variant_get(v, "$.etymology_number", "int").alias("etymology_number"),
    )


@R.query(r"""WITH x AS (SELECT x.id, g.script, CAST(x.raw_entry AS JSON) AS e FROM lexemes x JOIN languages g ON g.id = x.language_id WHERE g.script <> 'Latn'),
f AS (SELECT id, unnest(from_json(e -> 'forms', '[{"form":"VARCHAR","roman":"VARCHAR","source":"VARCHAR","tags":["VARCHAR"]}]')) AS f, generate_subscripts(from_json(e -> 'forms', '["JSON"]'), 1) AS i FROM x WHERE json_type(e, '$.forms') = 'ARRAY' AND script IN ('Cyrl', 'Grek', 'Deva', 'Arab', 'Hebr', 'Jpan', 'Kore')),
plain AS (SELECT id, i, f.form AS form, f.roman AS roman, list_has_any(list_transform(coalesce(f.tags, []), lambda t: lower(t)), ['romanization', 'romanisation', 'transliteration']) AS tagged FROM f
  WHERE coalesce(lower(f.source), '') NOT IN ('conjugation', 'declension', 'inflection') AND NOT list_has_any(list_transform(coalesce(f.tags, []), lambda t: lower(t)), string_split('plural singular dual genitive dative accusative nominative instrumental locative vocative prepositional partitive ablative oblique ergative construct past present future participle gerund infinitive imperative perfective imperfective aorist subjunctive comparative superlative definite indefinite possessive diminutive feminine masculine neuter inflection-template error-unknown-tag table-tags class non-past indicative formal informal polite sequential conditional causative passive honorific plain', ' ')))
SELECT x.id, x.script, coalesce(min_by(p.form, p.i) FILTER (WHERE p.tagged AND p.form <> ''), min_by(p.roman, p.i) FILTER (WHERE p.roman <> '')) AS romanization FROM x LEFT JOIN plain p ON p.id = x.id GROUP BY x.id, x.script""")
def romanize_pick(spark: SparkSession, d: str) -> DataFrame:
    """The Latin spelling that the entry of each lexeme in another script gives."""
    g = F.broadcast(table(spark, d, "languages").filter("script <> 'Latn'").select(F.col("id").alias("language_id"), "script"))
    return table(spark, d, "lexemes").join(g, "language_id").select("id", "script", romanize.romanization(F.col("raw_entry"), F.col("script")).alias("romanization"))


@R.query(r"""WITH w AS (SELECT s.id AS sense_id, list_filter(list_transform(string_split_regex(s.definition, '[;,]'), lambda c: regexp_replace(regexp_replace(c, '\([^)]*\)', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')),
  lambda c: length(c) >= 3 AND NOT regexp_matches(lower(c), '^(same as|see|variant of|a variant of|used in|form of) ')) AS clauses FROM senses s) SELECT sense_id, clauses[1] AS clause FROM w""")
def unihan_clause(spark: SparkSession, d: str) -> DataFrame:
    """The first usable clause of each definition."""
    return table(spark, d, "senses").select(F.col("id").alias("sense_id"), taxonomy.usable_clause(F.col("definition")).alias("clause"))


@R.query(f"""{_TIERS}, e AS (SELECT tier, language_code, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(lem, '[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}]')) AS n_single, count(*) FILTER (WHERE sole_alt) AS n_sole,
  count(*) FILTER (WHERE tier = 'C' AND (defn <> '' AND len(tags) >= 0)) AS n_worthy FROM tiers GROUP BY ALL) SELECT *, CASE WHEN language_code = 'cmn' THEN 'zh' ELSE language_code END AS language_group FROM e""")
def tier_extras(spark: SparkSession, d: str) -> DataFrame:
    """Single letters, sole triggers and senses worth a name by language, codes of one language under its first."""
    c = taxonomy.classify(sense_rows(spark, d))
    lem = F.regexp_replace(F.coalesce("lemma", F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    defn = F.regexp_replace(F.coalesce("definition", F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    out = c.groupBy("tier", "language_code").agg(
        F.count("*").alias("n"), F.count_if(lem.rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]$")).alias("n_single"), F.count_if("sole_alt").alias("n_sole"), F.count_if((F.col("tier") == "C") & (defn != "")).alias("n_worthy")
    )
    return out.withColumn("language_group", F.coalesce(*[F.when(F.col("language_code").isin(*codes), g) for g, codes in fixed.LANGUAGE_ALIASES.items()], F.col("language_code")))


@R.query()
def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    """The join key of every lexeme by the policy of its language. It needs compatibility forms, which SQL lacks; tests compare it with plain Python."""
    x = table(spark, d, "lexemes").select("id", "language_id", "lemma")
    g = table(spark, d, "languages").select(F.col("id").alias("language_id"), "code")
    return unicode_keys.with_lemma_key(x.join(g, "language_id", "left"), "lemma", "code", "key").select("id", "key")


_LATIN = {"Cyrl": ("абвгдезийклмнопрстуфыэъь", "abvgdeziyklmnoprstufye", {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "щ": "shch", "ш": "sh", "ю": "yu", "я": "ya"}),
          "Grek": ("αβγδεζηικλμνξοπρσςτυφω", "avgdeziiklmnxoprsstyfo", {"θ": "th", "χ": "ch", "ψ": "ps"})}


def _latin(script: str) -> str:
    """The lemma in Latin letters: letters of two and more first, then the marks off, then single letters."""
    single, to, several = _LATIN[script]
    c = "lemma"
    own = {**({"й": "y"} if script == "Cyrl" else {}), **(several if script == "Cyrl" else {})}
    for k, v in own.items():
        c = f"replace(replace({c}, '{k}', '{v}'), '{k.upper()}', '{v.title()}')"
    c = f"strip_accents({c})"
    for k, v in several.items():
        c = f"replace(replace({c}, '{k}', '{v}'), '{k.upper()}', '{v.title()}')"
    upper = "".join(x.upper() for x in single if x != "ς")
    upper_to = "".join(y.upper() for x, y in zip(single, to, strict=False) if x != "ς") + ""
    return f"translate({c}, '{single.replace('ъ', '').replace('ь', '')}{upper.replace('Ъ', '').replace('Ь', '')}ъьЪЬ', '{to}{upper_to}')"


@R.query(f"""WITH x AS (SELECT x.id, x.lemma, g.script FROM lexemes x JOIN languages g ON g.id = x.language_id WHERE g.script IN ('Cyrl', 'Grek')),
l AS (SELECT id, lemma, CASE script WHEN 'Cyrl' THEN {_latin('Cyrl')} ELSE {_latin('Grek')} END AS r, CASE script WHEN 'Cyrl' THEN regexp_full_match(strip_accents(replace(replace(lower(lemma), 'й', ''), 'ё', '')), '[а-яё]*([^\\p{{L}}][а-я]*)*') ELSE regexp_full_match(strip_accents(lower(lemma)), '[α-ω]*([^\\p{{L}}][α-ω]*)*') END AS known FROM x)
SELECT id, CASE WHEN known THEN nullif(trim(regexp_replace(r, '[\\s\\p{{Z}}]+', ' ', 'g')), '') END AS romanized FROM l""")
def transliterate(spark: SparkSession, d: str) -> DataFrame:
    """Cyrillic and Greek words in Latin letters, each distinct one once; null where a letter has none."""
    g = F.broadcast(table(spark, d, "languages").filter("script IN ('Cyrl', 'Grek')").select(F.col("id").alias("language_id"), "script"))
    x = table(spark, d, "lexemes").select("id", "language_id", "lemma").join(g, "language_id")
    words = x.select("lemma", "script").distinct().withColumn("romanized", romanize.romanized("lemma", "script"))
    return x.alias("x").join(words.alias("w"), F.expr("x.lemma <=> w.lemma AND x.script = w.script")).select("x.id", "w.romanized")


@R.query()
def script_census(spark: SparkSession, d: str) -> DataFrame:
    """The script of most letters of lemmas, by language."""
    words = table(spark, d, "lexemes").filter("lemma IS NOT NULL").groupBy("language_id", "lemma").agg(F.count("*").alias("n"))
    return words.groupBy("language_id", unicode_keys.dominant_script("lemma").alias("script")).agg(F.sum("n").alias("n_lexemes"))


@R.query(r"""WITH refs AS (SELECT word_text AS w, language_code FROM word_senses WHERE word_text IS NOT NULL), lex AS (SELECT x.lemma, g.code FROM lexemes x JOIN languages g ON g.id = x.language_id),
k AS (SELECT w, language_code, EXISTS (SELECT 1 FROM lex l WHERE l.code = r.language_code AND l.lemma = r.w) AS exact, EXISTS (SELECT 1 FROM lex l WHERE l.code = r.language_code AND lower(l.lemma) = lower(r.w)) AS lowered,
  EXISTS (SELECT 1 FROM lex l WHERE l.code = r.language_code AND regexp_replace(lower(l.lemma), '[-\s]', '', 'g') = regexp_replace(lower(r.w), '[-\s]', '', 'g')) AS joined FROM refs r)
SELECT language_code, count(*) AS n_refs, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE lowered) AS n_lowered, count(*) FILTER (WHERE joined) AS n_joined,
  count(*) FILTER (WHERE joined AND NOT exact) AS gain, count(*) FILTER (WHERE exact AND NOT joined) AS loss FROM k GROUP BY language_code""")
def key_policy_ab(spark: SparkSession, d: str) -> DataFrame:
    """How many references find a lexeme under three policies of keys, and what each gains and loses."""
    policies = {"exact": lambda c: F.col(c), "lowered": lambda c: F.lower(c), "joined": lambda c: F.regexp_replace(F.lower(c), r"[-\s]", "")}
    refs = table(spark, d, "word_senses").filter("word_text IS NOT NULL").groupBy("language_code", "word_text").agg(F.count("*").alias("n"))
    lex = table(spark, d, "lexemes").join(table(spark, d, "languages").select(F.col("id").alias("language_id"), F.col("code").alias("language_code")), "language_id").select("language_code", "lemma").distinct()
    for name, key in policies.items():
        keys = lex.select("language_code", key("lemma").alias(f"k_{name}")).filter(F.col(f"k_{name}").isNotNull()).distinct().withColumn(name, F.lit(True))
        refs = refs.withColumn(f"k_{name}", key("word_text")).join(keys, ["language_code", f"k_{name}"], "left").na.fill(False, [name])
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    exact, joined = F.col("exact"), F.col("joined")
    return refs.groupBy("language_code").agg(
        F.sum("n").alias("n_refs"), *[total(F.col(p)).alias(f"n_{p}") for p in policies], total(joined & ~exact).alias("gain"), total(exact & ~joined).alias("loss")
    )
