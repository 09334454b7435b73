"""Counters of events: in one pass over a table, or kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiweave.durable import _remove, shared_dir
from lexiweave.functions.keys import trimmed


def count_events(events: DataFrame, key: list[str], at: str = "ts") -> DataFrame:
    """(key, n, last_at): events and the last time of each key; combined before the shuffle."""
    return events.groupBy(*key).agg(F.count("*").alias("n"), F.max(at).alias("last_at"))


def count_words(events: DataFrame, request: str, word: str, at: str = "ts") -> DataFrame:
    """(word, n, last_at): requests that name a word, once each however often they do; blank words and null requests do not count."""
    w = events.filter(F.col(request).isNotNull()).select(request, F.lower(trimmed(word)).alias("word"), at).filter("word <> ''")
    once = w.groupBy(request, "word").agg(F.max(at).alias(at))
    return count_events(once, ["word"], at)


def counters_of(counters: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The counters of the wanted keys; keys without events have 0."""
    return wanted.select(*key).distinct().join(counters, key, "left").na.fill(0, ["n"])


def add_counts(old: DataFrame | None, batch: DataFrame, key: list[str]) -> DataFrame:
    """Counters after a batch of counters: numbers added, the later time kept."""
    both = batch if old is None else old.unionByName(batch)
    return both.groupBy(*key).agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


class StreamedCounters:
    """Counters that a stream keeps up in the shared folder.

    Each batch writes a new generation of the table under its own number, so a
    batch that is given again writes the same again and counts once. Readers
    take the highest generation that is complete.
    """

    def __init__(self, spark, name: str, key: list[str], at: str = "ts"):
        self.spark, self.key, self.at = spark, key, at
        self.root = f"{shared_dir(spark)}/lexiweave/counters-{name}"

    def _generations(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n.removeprefix("g")) for n in done if n.startswith("g"))

    def read(self, below: int | None = None) -> DataFrame | None:
        """The counters, or those before a batch; None before the first."""
        g = [x for x in self._generations() if below is None or x < below]
        return self.spark.read.parquet(f"{self.root}/g{g[-1]}") if g else None

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds a batch of events. Two generations are kept, as a batch may be given again."""
        merged = add_counts(self.read(number), count_events(batch, self.key, self.at), self.key)
        merged.write.mode("overwrite").parquet(f"{self.root}/g{number}")
        for g in self._generations()[:-2]:
            _remove(self.spark, f"{self.root}/g{g}")

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts the stream over what is there and what comes while it runs."""
        return events.writeStream.foreachBatch(lambda b, n: self.add(b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, late: str, key: list[str], at: str = "ts") -> DataFrame:
    """(start, key, n): events by tumbling window, where later ones than ``late`` are left out of a stream. An extension: the counters above have no time windows."""
    w = events.withWatermark(at, late) if events.isStreaming else events
    return w.groupBy(F.window(at, width).alias("w"), *key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *key, "n")
