"""Looking up senses: the star join, the dictionary order, ranking and collapsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.functions.keys import trimmed

#: Tags that speak against a sense, strongly and a little; fixed values.
HARD_DEMOTE_TAGS = ("rare", "uncommon", "figuratively", "humorous", "poetic", "literary", "neologism", "euphemistic", "in-compounds", "attributive", "relational")
SOFT_DEMOTE_TAGS = (
    "informal", "colloquial", "Internet", "US", "UK", "Scotland", "Ireland", "Australia", "Canada", "India", "New-Zealand", "South-Africa", "Philippines", "Northern-England",
)
#: Senses of a word that a lookup ranks, the first in dictionary order: the feature's own limit, by which a word of any number of senses stays bounded.
RANKED_SENSES = 1000


@dataclass(frozen=True)
class RankWeights:
    """Weights of the sense score; the values are fixed by the data they were tuned on."""

    etymology: float = 1.00
    primacy: float = 0.10
    hard_demote: float = 0.25
    soft_demote: float = 0.10
    gloss_depth: float = 0.08
    selection_tier_min: int = 5


def star(senses: DataFrame, lexemes: DataFrame, languages: DataFrame, options: DataFrame) -> DataFrame:
    """A row for each visible sense with its lexeme, language and, where served, its counter and overrides.

    A sense is visible unless its status says otherwise or its override hides
    it. Only the columns named here are read. The language dimension is small
    and of fixed size; AQE broadcasts it by its measured size.
    """
    s = senses.filter("visibility_status = 'visible'").select(
        F.col("id").alias("sense_id"), "lexeme_id", "sense_index", "source_order", F.col("definition").alias("base_definition"), "raw_glosses", "raw_tags"
    )
    x = lexemes.select(F.col("id").alias("lexeme_id"), "language_id", "lemma", "normalized_lemma", "romanization", "part_of_speech")
    g = languages.select(F.col("id").alias("language_id"), F.col("code").alias("language_code"), "script", "display_order")
    o = options.select("sense_id", F.coalesce("selection_count", F.lit(0)).alias("n_selected"), "pinned_rank", F.coalesce("is_hidden", F.lit(False)).alias("hidden"), F.col("definition").alias("override_definition"))
    j = s.join(x, "lexeme_id").join(g, "language_id").join(o, "sense_id", "left")
    return j.filter(~F.coalesce("hidden", F.lit(False))).withColumn("n_selected", F.coalesce("n_selected", F.lit(0).cast("long")))


def effective(override: str, base: str) -> Column:
    """The override unless it is null or empty, else the base."""
    return F.coalesce(F.nullif(F.col(override), F.lit("")), F.col(base))


def dictionary_order() -> list[Column]:
    """Pinned first, then the most selected, then as the dictionary has it; the id settles ties."""
    return [F.asc_nulls_last("pinned_rank"), F.desc("n_selected"), F.asc_nulls_last("source_order"), F.asc_nulls_last("sense_index"), F.asc("sense_id")]


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key with their rank.

    The limit is part of the window's filter, so each task drops what cannot be
    among the first before anything is shuffled, and a hot key stays small.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= limit)


def signals(df: DataFrame, word: list[str], weights: RankWeights = RankWeights()) -> DataFrame:
    """The rows with etymology_rank, n_hard, n_soft, gloss_depth, tier and score within each word.

    The etymology rank is the dense rank of (source_order, lexeme_id) from 0;
    the tier is the number of selections from ``selection_tier_min`` on, else 0.
    """
    tags = F.coalesce("raw_tags", F.array().cast("array<string>"))
    etymology = F.dense_rank().over(Window.partitionBy(*word).orderBy(F.asc_nulls_last("source_order"), "lexeme_id")) - 1
    glosses = F.size(F.filter(F.coalesce("raw_glosses", F.array().cast("array<string>")), lambda g: F.trim(g) != ""))
    score = (
        -weights.primacy * F.log1p(F.greatest(F.lit(0), F.coalesce("sense_index", F.lit(0)) - 1).cast("double"))
        - weights.etymology * F.col("etymology_rank")
        - weights.gloss_depth * F.col("gloss_depth")
        - weights.hard_demote * F.col("n_hard")
        - weights.soft_demote * F.col("n_soft")
    )
    return (
        df.withColumn("etymology_rank", etymology)
        .withColumn("n_hard", F.size(F.array_intersect(tags, F.array(*map(F.lit, HARD_DEMOTE_TAGS)))))
        .withColumn("n_soft", F.size(F.array_intersect(tags, F.array(*map(F.lit, SOFT_DEMOTE_TAGS)))))
        .withColumn("gloss_depth", F.greatest(glosses - 1, F.lit(0)))
        .withColumn("tier", F.when(F.col("n_selected") >= weights.selection_tier_min, F.col("n_selected")).otherwise(F.lit(0)).cast("long"))
        .withColumn("score", F.round(score, 6))
    )


def ranked_order() -> list[Column]:
    """Pinned, selection tier, score, dictionary order."""
    return [F.asc_nulls_last("pinned_rank"), F.desc("tier"), F.desc("score"), F.asc_nulls_last("source_order"), F.asc_nulls_last("sense_index"), F.asc("sense_id")]


def collapse(df: DataFrame, key: list[str], order: list[Column], row_id: str) -> DataFrame:
    """(key, row_id of the first, n_rows, absorbed): one row a key, its first by the order, and how many others it stands for.

    Counts and the first row are combined before the shuffle. The others' ids
    are given as a count and a sum, which any number of rows can be checked
    by; as rows they come from ``absorbed``.
    """
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(row_id).alias("id")))
    out = df.groupBy(*key).agg(first.alias("f"), F.count("*").alias("n_rows"), F.sum(F.col(row_id)).alias("s"))
    return out.select(*key, F.col("f.id").alias(row_id), "n_rows", (F.col("s") - F.col("f.id")).alias("absorbed_sum"))


def absorbed(df: DataFrame, key: list[str], collapsed: DataFrame, row_id: str) -> DataFrame:
    """(kept_id, absorbed_id): a row for each one that stands behind the first of its key. Null keys match null keys."""
    a, c = df.select(*key, F.col(row_id).alias("absorbed_id")).alias("a"), collapsed.filter("n_rows > 1").select(*key, F.col(row_id).alias("kept_id")).alias("c")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    return a.join(c, on).filter("absorbed_id <> kept_id").select("kept_id", "absorbed_id")


#: Display: the last gloss is the definition, up to three before it the group's path.
MAX_GROUP_SEGMENTS, REDUNDANT_CHARS = 3, 6


def display_split(glosses: Column) -> tuple[Column, Column]:
    """(definition, group path joined by ' > ') of a list of glosses.

    Blank glosses do not count. A path segment of at least REDUNDANT_CHARS
    letters and digits that the definition begins with says nothing and is
    left out.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    kept = F.filter(F.transform(F.coalesce(glosses, F.array().cast("array<string>")), trimmed), lambda g: g != "")
    definition = F.try_element_at(kept, F.lit(-1))
    before = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    path = F.filter(before, lambda g: ~((F.length(bare(g)) >= REDUNDANT_CHARS) & F.startswith(bare(definition), bare(g))))
    path = F.slice(path, F.greatest(F.size(path) - MAX_GROUP_SEGMENTS + 1, F.lit(1)), MAX_GROUP_SEGMENTS)
    return definition, F.array_join(path, " > ")
