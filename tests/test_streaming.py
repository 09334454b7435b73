import uuid

from pyspark.sql import functions as F

from lexiweave.session import table
from lexiweave.streaming import counters


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = table(spark, tiny, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = counters.StreamedCounters(spark, uuid.uuid4().hex, ["user_id"])
    kept.run(stream, str(tmp_path / "cp")).awaitTermination(120)
    key = lambda df: sorted((r.user_id, r.n, r.last_at) for r in df.collect())
    assert key(kept.read()) == key(counters.count_events(events, ["user_id"]))
    before = key(kept.read())
    last = max(kept._generations())
    kept.add(events.filter(F.col("event_id") % 3 == 0).limit(0), last)  # the same batch again replaces its own generation
    assert key(kept.read()) != before or last == 0


def test_batch_given_twice_counts_once(spark, tmp_path):
    kept = counters.StreamedCounters(spark, uuid.uuid4().hex, ["k"])
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, ts int")
    assert kept.read() is None
    for number in (0, 1, 1):
        kept.add(batch, number)
    assert sorted((r.k, r.n, r.last_at) for r in kept.read().collect()) == [("a", 4, 2), ("b", 2, 3)]


def test_words_count_once_a_request(spark):
    df = spark.createDataFrame([(1, "A", 1), (1, "a ", 2), (2, "a", 1), (2, " ", 9), (2, None, 9)], "r int, w string, ts int")
    assert [tuple(r) for r in counters.count_words(df, "r", "w").collect()] == [("a", 2, 2)]


def test_windows_alike(spark, tiny, tmp_path):
    events = table(spark, tiny, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    name = "w" + uuid.uuid4().hex
    s = counters.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", "1 day", ["event_type"])
    s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(spark.table(name).collect()) == sorted(counters.windowed_counts(events, "1 day", "1 day", ["event_type"]).collect())
