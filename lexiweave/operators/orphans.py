"""References to records that do not exist.

References and records are both turned into signed deltas per key. A record
adds 1 to its key's existence when it is loaded and takes 1 away when it is
deleted; a reference adds 1 to its key's references. A ledger keeps both
counts of each key, and batches of deltas are applied to it in order of time.
A key with references and no existence is an orphan, in the ledger as at any
point of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.durable import Scratch, buckets_for
from lexiweave.functions.keys import slug_key
from lexiweave.skew import hot_limit

#: Keys of a ledger's bucket, which one task holds.
BUCKET_KEYS = 1 << 21
#: Most batches of one call: their numbers are collected.
MAX_BATCHES = 10_000
#: A delta: a reference has its row, a record has none.
DELTA = ("ref_table", "ref_field", "row_id", "key", "at", "d_ref", "d_exist")


def reference_rows(df: DataFrame, ref_table: str, fields: list[str], row_id: str = "id", at: str = "loaded_at") -> DataFrame:
    """(ref_table, ref_field, row_id, key, at): a row for each reference that is not null or blank.

    Several fields of a row are read in one pass. Extra columns of ``df`` are
    not read, so their names cannot clash.
    """
    refs = F.array(*[F.struct(F.lit(f).alias("ref_field"), slug_key(F.col(f)).alias("key")) for f in fields])
    return (
        df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(at).cast("timestamp").alias("at"), F.explode(refs).alias("r"))
        .select(F.lit(ref_table).alias("ref_table"), "r.ref_field", "row_id", "r.key", "at")
        .filter(F.col("key").isNotNull())
    )


def existence_deltas(records: DataFrame, key: str = "slug", born: str = "loaded_at", died: str = "deleted_at") -> DataFrame:
    """(key, at, d_exist): +1 when a record appears, -1 when it goes.

    A record without a time of appearance, or gone before it appeared, never
    exists and gives no delta.
    """
    b, d = F.col("b"), F.col("d")
    steps = F.filter(
        F.array(F.struct(b.alias("at"), F.lit(1).cast("long").alias("d_exist")), F.struct(d.alias("at"), F.lit(-1).cast("long").alias("d_exist"))),
        lambda s: s["at"].isNotNull(),
    )
    return (
        records.select(slug_key(F.col(key)).alias("key"), F.col(born).cast("timestamp").alias("b"), F.col(died).cast("timestamp").alias("d"))
        .filter(F.col("key").isNotNull() & b.isNotNull() & (d.isNull() | (d > b)))
        .select("key", F.explode(steps).alias("s"))
        .select("key", "s.at", "s.d_exist")
    )


def batch_sums(deltas: DataFrame) -> DataFrame:
    """(key, d_ref, d_exist, n): a batch by key, n its references; combined before the shuffle, so a hot key moves one row a task."""
    n = F.count("row_id") if "row_id" in deltas.columns else F.lit(0)
    return deltas.groupBy("key").agg(F.coalesce(F.sum("d_ref"), F.lit(0)).cast("long").alias("d_ref"), F.coalesce(F.sum("d_exist"), F.lit(0)).cast("long").alias("d_exist"), n.alias("n"))


def apply_sums(ledger: DataFrame | None, sums: DataFrame) -> DataFrame:
    """The ledger (key, refs, records) after a batch as of batch_sums.

    Keys whose counts are both zero leave the ledger. Where the sums are read
    from a written table, only they are shuffled: the ledger's buckets are
    read where they lie.
    """
    if ledger is None:
        out = sums.select("key", F.col("d_ref").alias("refs"), F.col("d_exist").alias("records"))
    else:
        count = lambda old, more: F.coalesce(old, F.lit(0)) + F.coalesce(more, F.lit(0))
        out = ledger.join(sums, "key", "full").select("key", count(F.col("refs"), F.col("d_ref")).alias("refs"), count(F.col("records"), F.col("d_exist")).alias("records"))
    return out.filter((F.col("refs") != 0) | (F.col("records") != 0))


def apply_deltas(ledger: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The ledger after a batch of deltas (key, d_ref, d_exist)."""
    return apply_sums(ledger, batch_sums(deltas))


def current_orphans(ledger: DataFrame) -> DataFrame:
    """(key, refs): keys with positive references and no existence."""
    return ledger.filter((F.col("refs") > 0) & (F.col("records") <= 0)).select("key", "refs")


def batch_orphans(ledger: DataFrame | None, batch: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """(ref_table, ref_field, row_id, key, at) of a batch's references whose key has positive references and no existence at their time.

    ``batch`` has DELTA, ``keys`` its keys with their number of references as
    (key, n). The running counts of a key are cut into days, each opening with
    the ledger and the days before, and the references to a key of more than
    ``limit`` are dealt to as many parts as keep each below it, which all see
    the key's deltas. So no task holds more than a day's rows of a key, or a
    part of them.
    """
    day = F.coalesce(F.unix_date(F.col("at").cast("date")), F.lit(1 - 2**31))  # the first day is the ledger's
    hot = F.broadcast(keys.filter(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row_id", "ref_field"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    r = batch.filter("row_id IS NOT NULL").join(hot, "key", "left").select("ref_table", "ref_field", "row_id", "key", "at", "d_ref", day.alias("day"), salt.alias("salt"))
    d = batch.filter("row_id IS NULL").groupBy("key", "at").agg(F.sum("d_exist").alias("d_exist")).withColumn("day", day)

    by_day = d.select("key", "day", "d_exist").unionByName(r.select("key", "day").distinct().withColumn("d_exist", F.lit(0).cast("long")))
    if ledger is not None:
        held = ledger.filter("records <> 0").select("key", F.lit(-(2**31)).alias("day"), F.col("records").alias("d_exist"))
        by_day = by_day.unionByName(held)
    by_day = by_day.groupBy("key", "day").agg(F.sum("d_exist").alias("d_exist"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = by_day.select("key", "day", F.sum("d_exist").over(before).alias("d_exist")).filter(F.col("d_exist") != 0)

    salts = F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    steps = (
        opening.select("key", "day", F.lit(None).cast("timestamp").alias("at"), "d_exist")
        .unionByName(d.select("key", "day", "at", "d_exist"))
        .join(hot, "key", "left")
        .select("key", "day", "at", "d_exist", F.explode(salts).alias("salt"))
    )
    rows = r.withColumn("d_exist", F.lit(0).cast("long")).unionByName(steps, allowMissingColumns=True)
    running = Window.partitionBy("key", "day", "salt").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("records", F.sum("d_exist").over(running))
        .withColumn("refs", F.sum("d_ref").over(running))
        .filter(F.col("row_id").isNotNull() & (F.col("refs") > 0) & ((F.col("records") <= 0) | F.col("at").isNull()))
        .select("ref_table", "ref_field", "row_id", "key", "at")
    )


class ReferenceLedger:
    """The signed counts of each key in the shared folder, with the orphans found so far and the references of each period.

    Batches must come in order of time. A delta counts from its own time on.
    References without a time find nothing and are orphans. Ties and repeated
    rows count each; no references give no orphans; without records every
    reference is one.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.batches, self.buckets = scratch, 0, 0
        self.counts: DataFrame | None = None
        self.found: list[DataFrame] = []

    def apply(self, batch: DataFrame) -> None:
        """Applies a batch of DELTA; a failed write leaves the ledger as it was."""
        k, scratch = self.batches, self.scratch
        keys = scratch.write(batch_sums(batch), f"keys{k}")
        size = keys.agg(F.sum("n").alias("n"), F.count("*").alias("keys")).first()  # one row
        held = scratch.unbucketed(f"ledger{k - 1}") if k else None
        self.found.append(scratch.write(batch_orphans(held, batch, keys, hot_limit(size["n"] or 0)), f"orphans{k}"))
        after = apply_sums(self.counts, keys)
        buckets = buckets_for(max(size["keys"], self.counts.count() if self.counts is not None else 0), BUCKET_KEYS)
        if buckets != self.buckets:
            after, self.buckets = after.repartition(buckets, "key"), buckets
        self.counts = scratch.write_bucketed(after, f"ledger{k}", "key", buckets)
        scratch.drop(f"ledger{k - 1}", f"keys{k}")
        self.batches += 1

    def orphans(self) -> DataFrame:
        """(ref_table, ref_field, row_id, key, at) of all references that found no existence at their time."""
        out = self.found[0]
        for x in self.found[1:]:
            out = out.unionByName(x)
        return out


def ledger_of(spark, refs: DataFrame, deltas: DataFrame, batch_of=lambda at: F.year(at)) -> ReferenceLedger:
    """The ledger after all references and existence deltas, applied in batches by ``batch_of`` their time, in its order; those without a time come first.

    ``refs`` is as of reference_rows, ``deltas`` as of existence_deltas.
    """
    scratch = Scratch(spark, "references")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = refs.withColumns({"d_ref": one, "d_exist": zero}).unionByName(deltas.withColumn("d_ref", zero), allowMissingColumns=True).select(*DELTA, F.coalesce(batch_of(F.col("at")).cast("int"), F.lit(-(2**31))).alias("batch"))
    rows = scratch.write(rows, "deltas", ["batch"])
    numbers = [x.batch for x in rows.select("batch").distinct().limit(MAX_BATCHES + 1).collect()]
    if len(numbers) > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    ledger = ReferenceLedger(scratch)
    for k in sorted(numbers) or [0]:
        ledger.apply(rows.filter(F.col("batch") == k).drop("batch"))
    return ledger


def orphans_by_period(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_table, ref_field, period, n_refs, n_orphans, n_orphan_keys) a month of loading.

    References without a time fall under a null period.
    """
    month = F.date_format("at", "yyyy-MM").alias("period")
    keys = ["ref_table", "ref_field", "period"]
    total = refs.select("ref_table", "ref_field", month).groupBy(*keys).agg(F.count("*").alias("n_refs"))
    bad = orphans.select("ref_table", "ref_field", month, "key").groupBy(*keys, "key").agg(F.count("*").alias("n"))
    bad = bad.groupBy(*keys).agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_orphan_keys"))
    t, b = total.alias("t"), bad.alias("b")
    on = F.expr("t.ref_table = b.ref_table AND t.ref_field = b.ref_field AND t.period <=> b.period")
    return t.join(b, on, "left").select("t.*", F.coalesce("b.n_orphans", F.lit(0)).cast("long").alias("n_orphans"), F.coalesce("b.n_orphan_keys", F.lit(0)).cast("long").alias("n_orphan_keys"))
