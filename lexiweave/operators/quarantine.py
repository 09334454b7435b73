"""Loading CSV records while setting apart the ones that fail, with the reason.

Records are screened over columns and parsed in blocks by a columnar parser. A
block that fails is halved again and again until the bad records stand alone;
values are checked over columns. Only the records set apart go through the
slow strict scan that names the reason.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a word_senses record; fixed values.
WORD_SENSE_COLUMNS = (
    "language_code", "word_text", "part_of_speech", "concept_slug", "gloss", "is_primary", "equivalence_type",
    "sense_rank", "external_sense_id", "external_synset_id", "source_slug", "source_locator", "confidence", "review_status",
)
CONFIDENCES = ("high", "medium", "low")
REVIEW_STATUSES = ("unreviewed", "reviewed", "rejected")
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"
#: A byte order mark counts as a character of its record, so a quote behind it encloses no whole field; a loaded field is without it.
BOM = "\ufeff"
#: A text that holds a replacement character or a control character that ends no line.
_BAD_CHARACTER = r"[\x{fffd}\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
#: A record whose double quotes all enclose a field or stand doubled inside one.
_WELL_QUOTED = r'\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\z'
#: What the columnar parser reads in another way than the strict scan: other line ends, NUL, a byte order mark at its input's start.
_PARSED_OTHERWISE = r"[\r\x00]|\A\x{feff}"
#: Most records of a block.
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class RecordRules:
    """What a valid record is: its columns and the values some of them take."""

    columns: tuple[str, ...] = WORD_SENSE_COLUMNS
    text_column: str = "gloss"
    domains: tuple[tuple[str, tuple[str, ...]], ...] = (("confidence", CONFIDENCES), ("review_status", REVIEW_STATUSES))


def scan_fields(record: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken.

    A double quote may only enclose a whole field or stand doubled inside such
    a field; a backslash is an ordinary character.
    """
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            part, i = [], i + 1
            while True:
                j = record.find('"', i)
                if j < 0:
                    return None
                part.append(record[i:j])
                if record[j + 1 : j + 2] != '"':
                    break
                part.append('"')
                i = j + 2
            fields.append("".join(part))
            i = j + 1
            if i < n and record[i] != ",":
                return None
        else:
            j = record.find(",", i)
            j = n if j < 0 else j
            field = record[i:j]
            if '"' in field:
                return None
            fields.append(field)
            i = j
        if i >= n:
            return fields
        i += 1


def diagnose(record: str | None, rules: RecordRules) -> tuple[str | None, list[str] | None]:
    """(reason, fields) of one record: the first reason that applies, or None and its fields."""
    if record is None:
        return COLUMN_COUNT, None
    fields = scan_fields(record)
    if fields is None:
        return QUOTING, None
    if len(fields) != len(rules.columns):
        return COLUMN_COUNT, None
    by = dict(zip(rules.columns, fields, strict=True))
    if any(by[c].strip().lower() not in allowed for c, allowed in rules.domains):
        return INVALID_VALUE, None
    text = by[rules.text_column]
    if not any(unicodedata.category(x)[0] == "L" for x in text):
        return INVALID_VALUE, None
    if any(x == "\ufffd" or (unicodedata.category(x) == "Cc" and x not in "\n\r") for x in text):
        return INVALID_VALUE, None
    return None, [fields[0].removeprefix(BOM), *fields[1:]]


class Blocks:
    """The records of a batch that may be good, joined once, whose blocks are parsed where they lie.

    A screen over the whole column leaves out records that the parser reads in
    another way than the strict scan, those with quotes in the wrong places,
    which it would let pass, and those without quotes that have another number
    of commas.
    """

    def __init__(self, records: pa.Array, rules: RecordRules):
        self.rules = rules
        odd = pc.match_substring_regex(records, _PARSED_OTHERWISE)
        plain = pc.and_(pc.invert(pc.match_substring(records, '"')), pc.equal(pc.count_substring(records, ","), len(rules.columns) - 1))
        fit = pc.and_(pc.invert(odd), pc.or_(plain, pc.and_(pc.match_substring(records, '"'), pc.match_substring_regex(records, _WELL_QUOTED))))
        fit = np.asarray(fit.fill_null(False))
        self.at, self.unfit = np.flatnonzero(fit), np.flatnonzero(~fit)
        kept = records.take(pa.array(self.at)).cast(pa.large_string())
        lines = pc.binary_join_element_wise(kept, *(pa.scalar(x, pa.large_string()) for x in ("\n", "")))
        self.offsets = np.frombuffer(lines.buffers()[1], np.int64)[: len(kept) + 1] if len(kept) else np.zeros(1, np.int64)
        self.text = lines.buffers()[2]
        self.read = pacsv.ReadOptions(column_names=list(rules.columns), use_threads=False)
        self.parse = pacsv.ParseOptions(quote_char='"', double_quote=True, escape_char=False, newlines_in_values=True, ignore_empty_lines=False)
        self.convert = pacsv.ConvertOptions(column_types=dict.fromkeys(rules.columns, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False)

    def columns(self, a: int, b: int) -> pa.Table | None:
        """The records a to b as columns, or None where any one of them has another number of fields."""
        size = int(self.offsets[b] - self.offsets[a])
        self.read.block_size = min(size + 1, 2**31 - 1)  # the parser sets so much memory aside
        try:
            t = pacsv.read_csv(pa.BufferReader(self.text.slice(self.offsets[a], size)), read_options=self.read, parse_options=self.parse, convert_options=self.convert)
        except pa.ArrowInvalid:
            return None
        return t if t.num_rows == b - a else None

    def isolate(self, block_rows: int) -> tuple[pa.Table | None, np.ndarray, list[int]]:
        """(columns, their records' numbers, the numbers of the others): failing blocks are halved down to single records."""
        parts, at, alone, n = [], [], [], len(self.at)
        todo = [(lo, min(lo + block_rows, n)) for lo in range(0, n, block_rows)]
        while todo:
            a, b = todo.pop()
            t = self.columns(a, b)
            if t is not None:
                parts.append(t)
                at.append(self.at[a:b])
            elif b - a == 1:
                alone.append(int(self.at[a]))
            else:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        alone += self.unfit.tolist()
        if not parts:
            return None, np.empty(0, np.int64), alone
        t, at = pa.concat_tables(parts).combine_chunks(), np.concatenate(at)
        good = np.asarray(self.valid(t))
        return t.filter(good), at[good], [*alone, *at[~good].tolist()]

    def valid(self, t: pa.Table) -> pa.ChunkedArray:
        """Which rows have values as the rules want them."""
        text = t[self.rules.text_column]
        ok = pc.and_(pc.match_substring_regex(text, r"\p{L}"), pc.invert(pc.match_substring_regex(text, _BAD_CHARACTER)))
        for c, allowed in self.rules.domains:
            ok = pc.and_(ok, pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(t[c])), pa.array(allowed)))
        return ok


def load_records(df: DataFrame, record: str = "raw_line", keys: tuple[str, ...] = ("line_id",), rules: RecordRules = RecordRules(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, reason, the rules' columns): each record, loaded or with its reason.

    Valid records have a null reason and their values as strings; rejected ones
    have null values. A null record counts as of no columns. Other columns of
    ``df`` are not read. There is no shuffle.
    """
    kept = df.select(*keys, F.col(record).alias("_record"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("reason", T.StringType()), *[T.StructField(c, T.StringType()) for c in rules.columns]])
    names = list(keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = batch.column(len(names)).cast(pa.string())
            t, at, alone = Blocks(records, rules).isolate(block_rows)
            if t is not None and t.num_rows:
                yield from rows(batch, at, pa.nulls(t.num_rows, pa.string()), t.columns)
            if alone:
                judged = [diagnose(x, rules) for x in records.take(pa.array(alone)).to_pylist()]
                yield from rows(batch, alone, pa.array([r for r, _ in judged], pa.string()), [pa.array([f and f[i] for _, f in judged], pa.string()) for i in range(len(rules.columns))])

    def rows(batch: pa.RecordBatch, at: list[int] | np.ndarray, reason: pa.Array, columns: list) -> list[pa.RecordBatch]:
        own = [batch.column(i).take(pa.array(at)) for i in range(len(names))]
        return pa.table([*own, reason, *columns], names=[*names, "reason", *rules.columns]).to_batches()

    return kept.mapInArrow(blocks, schema)


def rejected(loaded: DataFrame, keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """(keys, reason) of the records that failed."""
    return loaded.filter(F.col("reason").isNotNull()).select(*keys, "reason")


def valid_word_senses(loaded: DataFrame, keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid records as typed word_senses rows; empty fields are null."""
    c = {n: F.when(F.col(n) != "", F.col(n)) for n in WORD_SENSE_COLUMNS}
    flag = F.lower(F.trim(c["is_primary"]))
    c["is_primary"] = F.when(flag.isin("true", "1", "yes"), True).when(flag.isin("false", "0", "no"), False)
    c["sense_rank"] = F.expr("try_cast(trim(sense_rank) AS int)")
    for n in ("confidence", "review_status"):
        c[n] = F.lower(F.regexp_replace(F.col(n), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return loaded.filter(F.col("reason").isNull()).select(*keys, *[v.alias(n) for n, v in c.items()])
