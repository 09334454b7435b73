from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.llm import ledger

SCHEMA = "sense_id long, language_code string, word string, definition string, key string, bucket int"


def rows(spark, data):
    return spark.createDataFrame([(i, lang, w, d, "clash", 0) for i, (lang, w, d) in enumerate(data, 1)], SCHEMA)


def found(df, batches=3):
    led, keyed = ledger.ledger_of(df, ["language_code", "word"], "definition", "sense_id", (F.col("sense_id") % batches).cast("int"))
    return {r.row_id: r.kept_id for r in ledger.collapsed(led, keyed).collect()}, {r.kept_id: r.duplicate_count for r in ledger.copies(led).collect()}


DATA = [
    ("en", "Word", "a big; small thing."), ("EN", "word ", "Small THING;a big;;"), ("en", "word", "a big; small things"), ("en", "word", None), ("en", "word", " \t"), ("en", "wo-rd", "(a  big) ; 'small' thing…"),
    ("de", "word", "a big; small thing."), (None, "word", "x"), (None, "WORD", "X!"), ("en", None, "x"), ("en", None, "x"), ("en", "", "x"), ("el", "ΛΌΓΟΣ", "n"), ("el", "λόγος", "n"), ("de", "straße", "n"), ("de", "STRASSE", "n"),
    ("en", "word", "..."), ("en", "word", "!"), ("en", "long", "ab " * 100_000), ("en", "long", "AB" * 100_000), ("en", "word", "a big small thing"),
]


def test_formatting_differences(spark):
    got, counts = found(rows(spark, DATA))
    assert got == {2: 1, 6: 1, 9: 8, 11: 10, 14: 13, 16: 15, 18: 17, 20: 19}
    assert counts == {1: 3, 3: 1, 7: 1, 8: 2, 10: 2, 12: 1, 13: 2, 15: 2, 17: 2, 19: 2, 21: 1}


def test_batches_do_not_change_the_result(spark):
    df = rows(spark, DATA)
    assert found(df, 1) == found(df, 5)
    assert found(df.limit(0)) == ({}, {})


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr("lexiweave.skew.HOT_ROWS", 10)
    got, counts = found(rows(spark, [("en", "w", "d" if i % 3 else f"x{i % 7}") for i in range(90)]))
    assert len(got) == 90 - 8 and counts[2] == 60 and set(got.values()) == set(range(1, 20, 3)) | {2}


def test_only_touched_buckets_are_rewritten(spark):
    led = ledger.Ledger(Scratch(spark, "t"), 16)
    key = lambda i: bytes([i]) * 16
    df = lambda ids: spark.createDataFrame([(i, key(i)) for i in ids], "row_id long, key binary")
    led.add(df(range(40)), "row_id")
    first = dict(led.generation)
    led.add(df([3, 3]), "row_id")
    assert sum(first[b] != led.generation[b] for b in first) == 1
    got = {bytes(r.key): (r.copies, r.first_id) for r in led.read().collect()}
    assert len(got) == 40 and got[key(3)] == (3, 3)
    led.add(df([]), "row_id")
    assert led.read().count() == 40


def test_the_ledger_is_not_shuffled(spark):
    df = spark.createDataFrame([(i, bytes([i]) * 16) for i in range(40)], "row_id long, key binary")
    led = ledger.Ledger(Scratch(spark, "t"), 4)
    led.add(df, "row_id")
    plan = led.merged(led.scratch.write(ledger.batch_counts(df, "row_id", 4), "b"), [0, 1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") : plan.index("FileScan")]


def test_parts_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PART_KEYS", 4)
    got, counts = found(rows(spark, [("en", "w", f"x{i % 30}") for i in range(90)]))
    assert len(got) == 60 and set(counts.values()) == {3}
    led = ledger.Ledger(Scratch(spark, "t"), 4)
    for n in (8, 30):
        led.add(spark.createDataFrame([(i, bytes([i]) * 16) for i in range(n)], "row_id long, key binary"), "row_id")
    assert led.parts == 8 and led.read().count() == 30
