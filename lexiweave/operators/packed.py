"""Several values packed in one field, split into one row a value.

Escaped characters and then quoted spans are replaced by numbered
placeholders, so that every delimiter left in the text is one. The text is
split, and each part gets its spans back by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.keys import SPACE, trimmed

#: Characters that part values unless quoted or escaped.
DELIMITERS = ",;|/\t\n\r，；、"
#: The marks of a placeholder: mark, number, END. Where a text holds one of them itself, that character becomes a placeholder too.
ESCAPED, QUOTED, END = "\ue000", "\ue001", "\ue002"
#: What is replaced first: an escaped character, a placeholder's own mark.
_ESCAPES = rf"(?s)\\.|[{ESCAPED}{QUOTED}{END}]"


def _class(delims: str) -> str:
    return "".join("\\" + c if c in r"|/\]^-" else c for c in delims)


def _span_pattern(delims: str) -> str:
    """An enclosed value with the delimiter and the white space before it, in a text without escapes.

    A quote opens only at a value's start and closes only at its end, so an
    apostrophe within a word is none. Double quotes stand doubled within a
    value; in single quotes, where the first quote ends no value, the last
    one before the next delimiter may.
    """
    d = _class(delims)
    end = rf"(?=[{SPACE}]*(?:[{d}]|\z))"
    double, curly = r'"(?:[^"]|"")*+"', "“[^”]*+”"
    single, loose = "'[^']*+'", f"'[^{d}]*'"
    return rf"(?:\A|[{d}])[{SPACE}&&[^{d}]]*+(?:{double}|{curly}|{single}{end}|{loose}){end}"


def _unquoted(span: Column) -> Column:
    """The value of a quoted span that has its quotes at both ends."""
    inner = F.substring(span, F.lit(2), F.length(span) - 2)
    return F.when(F.startswith(span, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner)


def _numbered(text: Column, pattern: str, mark: str, before: Column | None) -> Column:
    """The text with each match of the pattern replaced by a placeholder, behind what ``before`` keeps of it."""
    holder = lambda i: F.concat(F.lit(mark), i.cast("string"), F.lit(END))
    if before is not None:
        plain = holder
        holder = lambda i: F.concat(F.get(before, i - 1), plain(i))
    return F.array_join(F.transform(F.split(text, pattern, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(holder(i), p))), "")


def _filled(part: Column, mark: str, values: Column) -> Column:
    """A text with the placeholders of one kind replaced by their values."""
    bits = F.split(part, mark, -1)
    tail = F.transform(
        F.slice(bits, F.lit(2), F.greatest(F.size(bits) - 1, F.lit(0))),
        lambda b: F.concat(F.element_at(values, F.substring_index(b, END, 1).cast("int")), F.substring(b, F.instr(b, END) + 1, F.length(b))),
    )
    return F.concat(F.element_at(bits, 1), F.array_join(tail, ""))


def packed_values(df: DataFrame, field: str, out: str, delimiters: str = DELIMITERS) -> DataFrame:
    """``df`` with the non-empty values of a packed field, in order, as the ARRAY<STRING> ``out``.

    Null gives null; an empty or blank text gives an empty array. Brackets are
    a list's only around the whole text. A backslash takes the meaning of the
    next character; a last one stands for itself. A quote that opens or closes
    nowhere is a character of its value. The steps are columns of their own,
    so that a text's spans are found once, not once a value; texts without
    escapes or quotes need no lookups.
    """
    d = _class(delimiters)
    text = trimmed(F.col(field))
    text = F.when(text.rlike(r"(?s)^(\[.*\]|\{.*\})$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    pattern, none = _span_pattern(delimiters), F.array().cast("array<string>")
    first, spans, values = F.size("_escapes") > 0, F.size("_spans") > 0, F.col("_values")
    return (
        df.withColumn("_text", text)
        .withColumn("_escapes", F.when(F.col("_text").rlike(rf"[\\{ESCAPED}{QUOTED}{END}]"), F.regexp_extract_all("_text", F.lit(_ESCAPES), F.lit(0))).otherwise(none))
        .withColumn("_text", F.when(first, _numbered(F.col("_text"), _ESCAPES, ESCAPED, None)).otherwise(F.col("_text")))
        .withColumn("_escapes", F.transform("_escapes", lambda e: F.when(F.length(e) > 1, F.substring(e, 2, 1)).otherwise(e)))
        .withColumn("_spans", F.when(F.col("_text").rlike("[\"'“]"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
        .withColumn("_before", F.transform("_spans", lambda s: F.regexp_extract(s, rf"^[{d}]?", 0)))
        .withColumn("_text", F.when(spans, _numbered(F.col("_text"), pattern, QUOTED, F.col("_before"))).otherwise(F.col("_text")))
        .withColumn("_spans", F.transform("_spans", lambda s: _unquoted(F.regexp_replace(s, rf"^[{d}]?[{SPACE}]*", ""))))
        .withColumn("_values", F.split("_text", f"[{d}]", -1))
        .withColumn("_values", F.when(spans, F.transform(values, lambda p: _filled(p, QUOTED, F.col("_spans")))).otherwise(values))
        .withColumn("_values", F.when(first, F.transform(values, lambda p: _filled(p, ESCAPED, F.col("_escapes")))).otherwise(values))
        .withColumn("_values", F.transform("_values", trimmed))
        .withColumn(out, F.filter("_values", lambda v: v != ""))
        .drop("_text", "_escapes", "_spans", "_before", "_values")
    )


def split_packed(df: DataFrame, field: str, keys: list[str], value: str = "value", delimiters: str = DELIMITERS) -> DataFrame:
    """(keys, pos INT, value): a row for each non-empty value, pos from 1, repeats kept.

    Null, empty and blank fields give no row. Only ``keys`` and ``field`` are
    read, so other columns of any name do no harm. There is no shuffle: each
    row is split where it lies.
    """
    kept = df.select(*keys, F.col(field).alias("_field"))
    split = packed_values(kept, "_field", "_all", delimiters)
    # not the inner form: for that one the optimizer repeats the whole expression in a filter before it
    exploded = split.select(*keys, F.posexplode_outer("_all").alias("_p", "_v")).filter(F.col("_v").isNotNull())
    return exploded.select(*keys, (F.col("_p") + 1).cast("int").alias("pos"), F.col("_v").alias(value))
