"""Duplicates hidden by formatting, counted in a ledger that grows batch by batch.

A record's canonical key leaves out letter case, white space, punctuation and
the order of its parts. The ledger keeps, for each key, the number of copies
and the earliest one, which is that of the smallest id. It lies in buckets by
the key's hash: a batch is reduced to its own keys, joined in full with the
buckets it touches, and only those are written again. Each bucket is cut by
the key once more, into as many parts as the ledger's size asks for, so that
the join moves the batch and leaves the ledger where it lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.durable import Scratch, buckets_for
from lexiweave.skew import hot_limit, skew_join

#: Left out of every key: white space of any kind, punctuation, control characters.
IGNORED = r"[\s\p{Z}\p{P}\p{Cc}]+"
#: Where the parts of a definition end.
PART_ENDS = "[;；]"
#: Buckets of a ledger, which batches touch or not, and keys in a part of one, which one task holds with the same parts of the others.
BUCKETS, PART_KEYS = 16, 1 << 21
#: Most batches of one call: their numbers are collected.
MAX_BATCHES = 10_000

LEDGER_SCHEMA = "key binary, copies long, first_id long, bucket int"


def bare(c: Column | str) -> Column:
    """The text in one letter case, without white space and punctuation.

    Upper case is taken, as it alone joins both forms of the small sigma and
    the sharp s with its two letters.
    """
    return F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, IGNORED, ""))


def bare_parts(c: Column | str) -> Column:
    """The bare parts between semicolons in order of text, empty ones left out."""
    parts = F.transform(F.split(F.col(c) if isinstance(c, str) else c, PART_ENDS, -1), bare)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), ";")


def canonical_key(plain: list[str], in_parts: str) -> Column:
    """A 16-byte key of the columns ``plain`` and of ``in_parts`` regardless of its parts' order; null where ``in_parts`` is null or blank."""
    bits = [F.coalesce(F.concat(F.lit("="), bare(c)), F.lit("-")) for c in plain]
    key = F.unhex(F.md5(F.concat_ws("\x1f", *bits, bare_parts(in_parts)).cast("binary")))
    return F.when(F.regexp_replace(in_parts, r"[\s\p{Z}\x1c-\x1f\x85]+", "") != "", key)


def batch_counts(keyed: DataFrame, row_id: str, buckets: int) -> DataFrame:
    """(key, copies, first_id, bucket) of a batch, combined before the shuffle: a key of any size is a row a task."""
    counts = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("copies"), F.min(F.col(row_id).cast("long")).alias("first_id"))
    return counts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger's rows of the buckets the batch touches, after the batch: copies added, the earliest representative kept."""
    new = batch.select("key", F.col("copies").alias("n"), F.col("first_id").alias("f"), F.col("bucket").alias("b"))
    return ledger.join(new, "key", "full").select(
        "key",
        (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("copies"),
        F.least("first_id", "f").alias("first_id"),
        F.coalesce("bucket", "b").alias("bucket"),
    )


class Ledger:
    """A ledger in the shared folder: one generation of files for each bucket."""

    def __init__(self, scratch: Scratch, buckets: int = BUCKETS):
        self.scratch, self.buckets, self.parts = scratch, buckets, 0
        self.generation: dict[int, str] = {}
        self.tables: dict[str, DataFrame] = {}
        self.batches = 0

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The ledger, or the given buckets of it; other buckets' files are not opened."""
        tables = [self.scratch.unbucketed(name).filter(F.col("bucket").isin(own)).select("key", "copies", "first_id", "bucket") for name, own in self._tables(only).items()]
        return reduce(DataFrame.unionByName, tables) if tables else self.scratch.spark.createDataFrame([], LEDGER_SCHEMA)

    def _tables(self, only: list[int] | None = None) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for bucket, name in self.generation.items():
            if only is None or bucket in only:
                out.setdefault(name, []).append(bucket)
        return dict(sorted(out.items()))

    def merged(self, batch: DataFrame, touched: list[int]) -> DataFrame:
        """The touched buckets after the batch. Each generation is joined by itself, with the batch's rows of its buckets."""
        tables = self._tables(touched)
        new = [b for b in touched if b not in self.generation]
        parts = [merge(self.tables[name].filter(F.col("bucket").isin(own)), batch.filter(F.col("bucket").isin(own))) for name, own in tables.items()]
        if new or not parts:
            parts.append(batch.filter(F.col("bucket").isin(new)))
        return reduce(DataFrame.unionByName, parts)

    def add(self, keyed: DataFrame, row_id: str) -> None:
        """Adds a batch. It rewrites only the buckets that the batch touches; a failed write leaves the ledger as it was."""
        name = f"batch{self.batches}"
        batch = self.scratch.write(batch_counts(keyed, row_id, self.buckets), name)
        touched = {r.bucket: r.n for r in batch.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # at most as many as buckets
        if touched:
            merged = self.merged(batch, list(touched))
            parts = buckets_for(max(sum(touched.values()), self.read().count()), PART_KEYS)
            if parts != self.parts or len(self._tables(list(touched))) != 1:
                merged, self.parts = merged.repartition(parts, "key"), parts
            new = f"ledger{self.batches}"
            self.tables[new] = self.scratch.write_bucketed(merged, new, "key", parts, "bucket")
            before = {self.generation.get(b) for b in touched}
            self.generation |= dict.fromkeys(touched, new)
            self.scratch.drop(name, *[x for x in before - set(self.generation.values()) if x])
        self.batches += 1


def ledger_of(rows: DataFrame, plain: list[str], in_parts: str, row_id: str, batch_of: Column) -> tuple[Ledger, DataFrame]:
    """(ledger, keyed rows) after adding the rows in batches by the number ``batch_of``, in its order; those without one come first.

    Records whose ``in_parts`` is null or blank have no key and are no copies.
    """
    scratch = Scratch(rows.sparkSession, "ledger")
    keyed = rows.select(F.col(row_id).cast("long").alias("row_id"), canonical_key(plain, in_parts).alias("key"), F.coalesce(batch_of.cast("int"), F.lit(-(2**31))).alias("batch"))
    keyed = scratch.write(keyed, "keyed", ["batch"])
    numbers = [r.batch for r in keyed.select("batch").distinct().limit(MAX_BATCHES + 1).collect()]
    if len(numbers) > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    ledger = Ledger(scratch)
    for i in sorted(numbers):
        ledger.add(keyed.filter(F.col("batch") == i), "row_id")
    return ledger, keyed


def collapsed(ledger: Ledger, keyed: DataFrame) -> DataFrame:
    """(kept_id, row_id): each row but the earliest of its key. Keys of very many rows are met by broadcast."""
    kept = ledger.read().filter("copies > 1").select("key", "first_id", "copies")
    limit = hot_limit(keyed.count())
    hot = kept.filter(F.col("copies") >= limit).select("key")
    joined = skew_join(keyed.filter(F.col("key").isNotNull()), kept.drop("copies"), "key", hot)
    return joined.filter("row_id <> first_id").select(F.col("first_id").alias("kept_id"), "row_id")


def copies(ledger: Ledger) -> DataFrame:
    """(kept_id, duplicate_count): one row for each distinct record with its number of copies, itself included."""
    return ledger.read().select(F.col("first_id").alias("kept_id"), F.col("copies").alias("duplicate_count"))
