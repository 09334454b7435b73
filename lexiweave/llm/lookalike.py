"""Texts that look the same but differ in their characters.

Look-alike characters are mapped onto one another by the public table of
confusables and by compatibility decompositions of width and typeface,
characters that show nothing are left out, and the results are grouped in SQL
under a Unicode collation that keeps case and accents apart but takes composed
and decomposed forms as equal. Each group gets one canonical form, joined back
to the rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.skew import hot_keys, hot_limit, salted_join, skew_join

#: Arabic letters that look like the Persian ones, and the kana that look alike in both syllabaries; fixed values.
ARABIC_LOOKALIKES = ("كىي", "کیی")
KANA_LOOKALIKES = ("ヘベペ", "へべぺ")
#: The small palochka has no dot, unlike the letter that the table takes it for; a fixed value.
PALOCHKA = ("ӏ", "l")
#: Spaces and hyphens that look like the plain ones; fixed values.
SPACES = "\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\ufe63"
#: Characters that show nothing; fixed values.
INVISIBLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\ufe0e\ufe0f"
#: The joiners show nothing in most scripts, but shape these where they stand between two of their letters.
JOINERS = "\u200c\u200d"
#: What stands for the joiners that count, since the collation passes joiners over.
COUNTED = "\ue000\ue001"
_SHAPED = r"\p{IsArabic}\p{IsSyriac}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsGujarati}\p{IsGurmukhi}\p{IsSinhala}\p{IsMongolian}"
#: Kinds of compatibility decompositions that change a character's width, typeface or place in a joined word only.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Blocks of Roman numerals and ligatures, which look like the letters that they are made of.
COMPOUNDS = ((0x2160, 0x2180), (0xFB00, 0xFB18))
#: Blocks of the syllables and ideographs of eastern Asia, which the table of confusables is not asked for.
FAR_BLOCKS = ((0x2E80, 0x3040), (0x3100, 0xA4D0), (0xAC00, 0xD7B0), (0xF900, 0xFB00), (0x16FE0, 0x1D000))


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def _confusables(skeleton: Callable[[str], str]) -> dict[str, str]:
    """Letters that look like one of another script, from the public table of confusables (Unicode Technical Standard 39).

    The table's prototypes leave letter case aside and join letters of one
    script; so a letter is mapped only to one of its own category, and where
    several letters of a script had the same target, only one is: one whose
    other case is mapped alike, else the first. Letters of the Latin script
    stay, and so do those without case that compose with marks, since their
    composed forms could not follow them.
    """
    category = unicodedata.category
    composing = {d[0] for c in map(chr, range(0x80, 0x1F000)) if category(c) == "Lo" and len(d := unicodedata.normalize("NFD", c)) > 1}
    plain = [chr(c) for c in range(0x21, 0x7F)]
    letters = [chr(c) for c in range(0x80, 0x1F000) if category(chr(c))[0] == "L" and not any(a <= c < b for a, b in FAR_BLOCKS)]
    prototype = dict(zip([*plain, *letters], skeleton("\n".join([*plain, *letters])).split("\n"), strict=True))
    first: dict[tuple[str, str], str] = {}
    for c in plain:
        first.setdefault((prototype[c], category(c)), c)
    target: dict[str, str] = {}
    for c in letters:
        p = prototype[c]
        t = first.get((p, category(c)), p if len(p) == 1 and category(p) == category(c) else None)
        if t is not None and t != c and c not in composing and _script(c) not in ("LATIN", _script(t)):
            target[c] = t
    rivals: dict[tuple[str, str], list[str]] = {}
    for c, t in target.items():
        rivals.setdefault((_script(c), t), []).append(c)
    out = {}
    for (_, t), cs in rivals.items():
        out[next((c for c in cs if target.get(c.swapcase()) == t.swapcase()), cs[0])] = t
    return out


_map: dict[str, str] = {}


def character_map(spark: SparkSession) -> dict[str, str]:
    """Each look-alike character and the one it is mapped to; the same in every session, so it is made once."""
    if not _map:
        m = _confusables(spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton)
        for source, target in (ARABIC_LOOKALIKES, KANA_LOOKALIKES, PALOCHKA):
            m |= dict(zip(source, target, strict=True))
        m |= dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-")
        for c in map(chr, range(0x80, 0x20000)):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1 and to != c and unicodedata.decomposition(c).startswith(SAME_LOOK):
                m[c] = m.get(to, to)
        for c in map(chr, range(0x80, 0x3000)):
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and parts[0] in m and c not in m:
                joined = unicodedata.normalize("NFC", m[parts[0]] + parts[1:])
                if len(joined) == 1:
                    m[c] = joined
        _map.update(m)
    return _map


def compounds(m: dict[str, str]) -> dict[str, str]:
    """Characters that stand for several, with those: what looks like several letters, and letters with marks whose look-alike is not composed with them."""
    points = [chr(c) for a, b in COMPOUNDS for c in range(a, b)]
    out = {c: unicodedata.normalize("NFKC", c) for c in points if unicodedata.category(c)[0] in "LN"}
    out |= {c: d for c in map(chr, range(0x80, 0x3000)) if c not in m and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in m}
    return {c: d for c, d in out.items() if d != c}


def look_key(spark: SparkSession, c: Column | str) -> Column:
    """The text with look-alikes mapped and invisible characters left out, to be compared under the collation.

    A text of plain characters is its own key.
    """
    text = F.col(c) if isinstance(c, str) else c
    m = character_map(spark)
    several = compounds(m)
    spelling = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelt = F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(spelling, x), x)), "")
    spelt = F.when(text.rlike(f"[{''.join(several)}]"), spelt).otherwise(text)
    mapped = F.translate(spelt, "".join(m) + INVISIBLE, "".join(m.values()))
    loose = rf"(?<![{_SHAPED}{JOINERS}\p{{M}}])[{JOINERS}]++|[{JOINERS}]++(?![{_SHAPED}\p{{M}}])"
    joined = F.translate(F.regexp_replace(F.regexp_replace(mapped, loose, ""), rf"([{JOINERS}])\1+", "$1"), JOINERS, COUNTED)
    mapped = F.when(text.rlike(f"[{JOINERS}]"), joined).otherwise(mapped)
    return F.when(text.rlike(r"^[\x20-\x7e]*$"), text).otherwise(mapped)


def collation_key(spark: SparkSession, c: Column) -> Column:
    """The bytes by which the UNICODE collation compares a text, so that they are found once and not in every comparison.

    Catalyst puts this expression into groupings and joins of collated
    columns; it has no function of its own.
    """
    utils = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(utils.column(spark._jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(utils.expression(F.collate(c, "UNICODE")._jc))))


def look_classes(df: DataFrame, scope: str, fields: list[str], scratch: Scratch) -> DataFrame:
    """(field, scope, value, canonical, n_rows, n_forms): the distinct values of each field with the canonical member of their class.

    The canonical member is the commonest value, the first in byte order among
    ties, so it does not depend on how the rows are laid out; n_rows counts a
    value's rows and n_forms the values of its class. Null values are in none;
    a null scope is a scope of its own. Values are counted before they are
    grouped, so a common one is a row a task, and their keys are found once.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = df.select(F.col(scope).alias("scope"), values.alias("v")).select("v.field", "scope", "v.value").filter("value IS NOT NULL")
    counts = rows.groupBy("field", "scope", "value").agg(F.count("*").alias("n_rows"))
    keyed = scratch.write(counts.withColumn("look", collation_key(df.sparkSession, look_key(df.sparkSession, "value"))), "keyed")
    classes = keyed.groupBy("field", "scope", "look").agg(F.min(F.struct((-F.col("n_rows")).alias("n"), F.col("value").alias("value"))).alias("first"), F.count("*").alias("n_forms"))
    k, c = keyed.alias("k"), classes.alias("c")
    on = F.expr("k.field = c.field AND k.scope <=> c.scope AND k.look = c.look")
    return k.join(c, on).select("k.field", "k.scope", "k.value", F.col("c.first.value").alias("canonical"), "k.n_rows", "c.n_forms")


def unify(df: DataFrame, scope: str, fields: list[str], prefix: str = "canonical_") -> DataFrame:
    """The rows with the canonical form of each of the fields within ``scope`` in a column of its own.

    A null value keeps null; a null scope is a scope of its own. Only the
    values that change are joined, and rows of hot values meet them by
    broadcast.
    """
    scratch = Scratch(df.sparkSession, "looks")
    changed = scratch.write(look_classes(df, scope, fields, scratch).filter("value <> canonical"), "changed")
    total, out = df.count(), df
    for f in fields:
        own = changed.filter(F.col("field") == f).select(F.struct("scope", "value").alias("_k"), F.col("canonical").alias("_c"), "n_rows")
        rows = out.withColumn("_k", F.struct(F.col(scope).alias("scope"), F.col(f).alias("value")))
        joined = skew_join(rows, own.drop("n_rows"), "_k", own.filter(F.col("n_rows") >= hot_limit(total)).select("_k"), "left")
        out = joined.withColumn(prefix + f, F.coalesce("_c", f)).drop("_k", "_c")
    return out


def look_pairs(df: DataFrame, scope: str, fields: list[str], row_id: str) -> DataFrame:
    """(field, id_a, id_b): the pairs of rows of one scope whose values in a field look the same and differ in code points.

    id_a is the smaller. Rows with equal values are no pair; a null value or
    scope pairs with nothing. The classes are found over distinct values; rows
    are marked with their class, and only rows of classes of several forms
    meet, dealt to several tasks where a class is hot.
    """
    scratch = Scratch(df.sparkSession, "looks")
    df = df.filter(F.col(scope).isNotNull())
    several = scratch.write(look_classes(df, scope, fields, scratch).filter("n_forms > 1"), "several")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(scope).alias("scope"), F.col(f).alias("value")) for f in fields]))
    rows = df.select(values.alias("k"), F.col(row_id).alias("id")).filter("k.value IS NOT NULL")
    named = several.select(F.struct("field", "scope", "value").alias("k"), F.struct("field", "scope", "canonical").alias("c"), "n_rows")
    hot = named.filter(F.col("n_rows") >= hot_limit(df.count() * len(fields))).select("k")
    marked = scratch.write(skew_join(rows, named.select("k", "c"), "k", hot).select("c", F.col("k.value").alias("value"), "id"), "marked")
    a = marked.select("c", F.col("value").alias("va"), F.col("id").alias("ia"))
    b = marked.select("c", F.col("value").alias("vb"), F.col("id").alias("ib"))
    pairs = salted_join(a, b, "c", hot_keys(marked, "c", marked.count()), "ia").filter("va < vb")
    return pairs.select("c.field", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
