"""Tiers of senses by ordered rules, which rule spoke, and what follows from tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions import fixed
from lexiweave.functions.keys import trimmed


@dataclass(frozen=True)
class SenseColumns:
    """Where the rules find a sense's parts."""

    pos: str = "part_of_speech"
    tags: str = "raw_tags"
    lemma: str = "lemma"
    definition: str = "definition"
    language: str = "language_code"


def clean_tags(tags: Column) -> Column:
    """The tags trimmed and in lower case, without null and blank ones."""
    t = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(trimmed(x)))
    return F.filter(t, lambda x: F.coalesce(x != "", F.lit(False)))


def _any_of(tags: Column, listed: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, listed)))


def letters_only(lemma: Column, language: Column) -> Column:
    """Whether a lemma is made of letters, hyphens, apostrophes and spaces, and of what its language spells with besides."""
    marked = lemma.rlike(r"^[\p{L}\p{Mn}\p{Mc}' -]*$") & lemma.rlike(r"\p{L}")
    out = F.when(language.isin(*[x for x in fixed.MARK_LANGUAGES if x not in fixed.EXTRA_LETTERS]), marked)
    for code, extra in fixed.EXTRA_LETTERS.items():
        marks = r"\p{Mn}\p{Mc}" if code in fixed.MARK_LANGUAGES else ""
        out = out.when(language == code, lemma.rlike(rf"^[\p{{L}}{marks}' {extra}-]*$") & lemma.rlike(r"\p{L}"))
    return out.otherwise(lemma.rlike(r"^[\p{L}' -]*$"))


def tier_rule(tags: Column, cols: SenseColumns = SenseColumns()) -> Column:
    """The number of the first of the 13 rules that applies; ``tags`` are clean ones.

    Null texts count as empty. Lemmas are taken as composed (NFC), as the
    tables hold them after the look-alike operator.
    """
    pos = F.lower(trimmed(F.coalesce(F.col(cols.pos), F.lit(""))))
    lemma = trimmed(F.coalesce(F.col(cols.lemma), F.lit("")))
    definition = trimmed(F.coalesce(F.col(cols.definition), F.lit("")))
    language = F.coalesce(F.col(cols.language), F.lit(""))
    first = F.left(lemma, F.lit(1))
    rules = [
        F.length(definition) < 3,
        lemma == "",
        pos.isin(*fixed.TIER_A_POS),
        _any_of(tags, fixed.TIER_A_TAGS),
        lemma.rlike(r"\p{Nd}"),
        F.startswith(lemma, F.lit("-")) | F.endswith(lemma, F.lit("-")),
        ~letters_only(lemma, language),
        lemma.rlike(r"^[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]$"),
        pos.isin(*fixed.TIER_B_POS),
        _any_of(tags, fixed.TIER_B_TAGS),
        F.contains(lemma, F.lit(" ")),
        ~language.isin(*fixed.CAPITALIZING_LANGUAGES) & first.rlike(r"\p{Lu}") & (lemma != F.upper(lemma)),
    ]
    out = F.when(rules[0], 1)
    for i, r in enumerate(rules[1:], 2):
        out = out.when(r, i)
    return out.otherwise(13)


def tier_of(rule: Column) -> Column:
    """A for rules 1 to 8, B for 9 to 12, C else."""
    return F.when(rule <= 8, "A").when(rule <= 12, "B").otherwise("C")


def classify(df: DataFrame, cols: SenseColumns = SenseColumns()) -> DataFrame:
    """The rows with rule, tier and sole_alt.

    sole_alt: the sense is of tier A only because it is tagged as another
    form, so that it might be kept where its target is missing.
    """
    tags = clean_tags(F.col(cols.tags))
    rule = tier_rule(F.col("_tags"), cols)
    less = F.array_except(F.col("_tags"), F.array(*map(F.lit, fixed.ALT_TAGS)))
    out = df.withColumn("_tags", tags).withColumn("rule", rule).withColumn("tier", tier_of(F.col("rule")))
    sole = (F.col("tier") == "A") & _any_of(F.col("_tags"), fixed.ALT_TAGS) & (tier_of(tier_rule(less, cols)) != "A")
    return out.withColumn("sole_alt", sole).drop("_tags")


def purge_reasons(classified: DataFrame) -> DataFrame:
    """The rows of tier A with the reason for it."""
    reason = F.coalesce(*[F.when(F.col("rule") == i, r) for i, r in enumerate(("short definition", "no lemma", "part of speech", "tag", "digit", "hyphen at the edge", "odd characters", "single letter"), 1)])
    return classified.filter("tier = 'A'").withColumn("reason", reason)


def transitions(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    """(from_tier, to_tier, n) of the rows in both."""
    b, a = before.select(row_id, F.col("tier").alias("from_tier")), after.select(row_id, F.col("tier").alias("to_tier"))
    return b.join(a, row_id).groupBy("from_tier", "to_tier").agg(F.count("*").alias("n"))


def usable_clause(definition: Column, min_chars: int = 3) -> Column:
    """The first clause between semicolons or commas that is no cross-reference and long enough, without brackets; null where there is none."""
    clauses = F.transform(F.split(definition, "[;,]"), lambda c: trimmed(F.regexp_replace(c, r"\([^)]*\)", "")))
    fits = lambda c: (F.length(c) >= min_chars) & ~F.lower(c).rlike("^(same as|see|variant of|a variant of|used in|form of) ")
    return F.try_element_at(F.filter(clauses, fits), F.lit(1))
