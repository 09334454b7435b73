import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiweave.operators import flatten, orphans, packed, quarantine


def ts(day, hour=0):
    return datetime(2024, 1, day, hour)


REF = "id long, slug string, loaded_at timestamp, key string, n long"
CON = "slug string, loaded_at timestamp, deleted_at timestamp, key string"


def orphan_ids(spark, refs, concepts, **kw):
    r = orphans.reference_rows(spark.createDataFrame(refs, REF), "t", ["slug"])
    d = orphans.existence_deltas(spark.createDataFrame(concepts, CON))
    return sorted(x.row_id for x in orphans.ledger_of(spark, r, d, **kw).orphans().collect())


def test_orphans_in_time(spark):
    concepts = [("a", ts(2), ts(5), "x"), (" A\t", ts(5), None, "x"), ("b", ts(3), ts(3), "x"), ("c", None, None, "x"), (None, ts(1), None, "x"), ("d", ts(2), ts(4), None), ("d", ts(2), ts(4), None)]
    refs = [
        (1, "a", ts(1), "k", 0), (2, "A ", ts(2), "k", 0), (3, "a", ts(4), "k", 0), (4, "a", ts(5), "k", 0), (5, "b", ts(3), "k", 0), (6, "c", ts(9), "k", 0),
        (7, None, ts(9), "k", 0), (8, " \n", ts(9), "k", 0), (9, "a", None, "k", 0), (10, "zz", ts(9), "k", 0), (11, "d", ts(3), "k", 0), (12, "d", ts(4), "k", 0), (12, "d", ts(4), "k", 0),
    ]
    assert orphan_ids(spark, refs, concepts) == [1, 5, 6, 9, 10, 12, 12]
    from pyspark.sql import functions as F

    assert orphan_ids(spark, refs, concepts, batch_of=F.dayofmonth) == [1, 5, 6, 9, 10, 12, 12]


def test_orphans_empty_tables(spark):
    assert orphan_ids(spark, [], [("a", ts(1), None, "")]) == []
    assert orphan_ids(spark, [(1, "a", ts(1), "", 0)], []) == [1]


def test_orphans_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr("lexiweave.skew.HOT_ROWS", 5)
    concepts = [("a", ts(2), ts(4), ""), ("a", ts(6), None, "")]
    refs = [(i, "a", ts(1 + i % 8, i % 24), "", 0) for i in range(200)]
    want = [i for i in range(200) if not (ts(2) <= ts(1 + i % 8, i % 24) < ts(4) or ts(1 + i % 8, i % 24) >= ts(6))]
    assert orphan_ids(spark, refs, concepts) == want


def test_ledger_is_kept_across_batches(spark):
    from lexiweave.durable import Scratch

    ledger = orphans.ReferenceLedger(Scratch(spark, "t"))
    schema = "ref_table string, ref_field string, row_id long, key string, at timestamp, d_ref long, d_exist long"
    ref = lambda i, k, day, n=1: ("t", "f", i, k, ts(day), n, 0)
    record = lambda k, day, n: (None, None, None, k, ts(day), 0, n)
    for rows in ([ref(1, "a", 1), record("b", 1, 1)], [ref(2, "b", 2), record("a", 3, 1), ref(3, "a", 4)], [], [record("b", 5, -1), ref(4, "b", 6), ref(5, "b", 7, -1), ref(6, "a", 6)]):
        ledger.apply(spark.createDataFrame(rows, schema))
    assert sorted(r.row_id for r in ledger.orphans().collect()) == [1, 4]
    assert {r.key: (r.refs, r.records) for r in ledger.counts.collect()} == {"a": (3, 1), "b": (1, 0)}
    assert [(r.key, r.refs) for r in orphans.current_orphans(ledger.counts).collect()] == [("b", 1)]


def test_applying_a_batch_does_not_shuffle_the_ledger(spark):
    from lexiweave.durable import Scratch

    scratch = Scratch(spark, "t")
    kept = scratch.write_bucketed(spark.createDataFrame([(f"k{i}", 1, 0) for i in range(50)], "key string, refs long, records long").repartition(2, "key"), "l", "key", 2)
    sums = scratch.write(orphans.batch_sums(spark.createDataFrame([("k1", 1, 1)], "key string, d_ref int, d_exist int")), "sums")
    plan = orphans.apply_sums(kept, sums)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") : plan.index("FileScan")]


def test_ledger_settles_late_records(spark):
    refs = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 1, 0)], "key string, d_ref int, d_exist int")
    ledger = orphans.apply_deltas(None, refs)
    late = spark.createDataFrame([("a", 0, 1)], "key string, d_ref int, d_exist int")
    assert {(r.key, r.refs) for r in orphans.current_orphans(orphans.apply_deltas(ledger, late)).collect()} == {("b", 2)}


DELIMS = set(packed.DELIMITERS)


def scan(text):
    """The values of a packed text, character by character: first escapes, then one value after the other."""
    t = text.strip()
    if len(t) > 1 and t[0] + t[-1] in ("[]", "{}"):
        t = t[1:-1]
    chars, i = [], 0  # (character, whether it is escaped)
    while i < len(t):
        escaped = t[i] == "\\" and i + 1 < len(t)
        chars.append((t[i + escaped], escaped))
        i += 1 + escaped
    delim = lambda k: k < len(chars) and not chars[k][1] and chars[k][0] in DELIMS
    mark = lambda k, m: k < len(chars) and chars[k] == (m, False)
    blank = lambda k: k < len(chars) and not chars[k][1] and chars[k][0].isspace()

    def ends(k):
        while blank(k) and not delim(k):
            k += 1
        return k if k >= len(chars) or delim(k) else None

    def enclosed(j):
        """(the value that a quote at j encloses, where it ends), or None."""
        for q, close in (('"', '"'), ("“", "”"), ("'", "'")):
            if mark(j, q):
                buf, k = "", j + 1
                while k < len(chars) and not (mark(k, close) and not (q == '"' and mark(k + 1, '"'))):
                    k += 1 + mark(k, '"') * (q == '"')
                    buf += chars[k - 1][0]
                if k < len(chars) and ends(k + 1) is not None:
                    return buf, ends(k + 1)
        if mark(j, "'"):
            k = j + 1
            while k < len(chars) and not delim(k):
                k += 1
            for m in range(k - 1, j, -1):
                if mark(m, "'") and ends(m + 1) is not None:
                    return "".join(c for c, _ in chars[j + 1 : m]), ends(m + 1)
        return None

    out, i = [], 0
    while i <= len(chars):
        j = i
        while blank(j) and not delim(j):
            j += 1
        value, k = enclosed(j) or ("", None)
        if k is None:
            k = i
            while k < len(chars) and not delim(k):
                value, k = value + chars[k][0], k + 1
        if value.strip():
            out.append(value.strip())
        i = k + 1
    return out


PACKED = [
    None, "", "  ", "a", "a;b", " a , b ,, c ", "['a, b', \"c's\", 'd']", '{"x"}', 'a|"b|c"|a', '"the ""tepid"" x"|y', "tide's end;it's", "a\\;b;c", "a\\|b|c",
    "“p;q”/r", "x\ty\nz", "日、月；火，水", "a (b, c)", "'it\\'s', b", "1;", "a\\", '"open|b', "[]", "a-b/c d", '" padded "', "a,b" * 3, 'a,          "b,c"', '"|"],', "'it's'; 'Rock 'n' Roll'", "a\\;\"b;c\"", '"a\\"b",c', "\ue000,\ue001\ue002;'\ue000,x'", '"a""b"" c",""', "\\",
]


def test_packed_cases(spark):
    df = spark.createDataFrame([(i, s, "clash", 0) for i, s in enumerate(PACKED)], "row_id int, synonyms string, value string, pos int")
    got = {}
    for r in packed.split_packed(df, "synonyms", ["row_id"]).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append((r.pos, r.value))
    for i, s in enumerate(PACKED):
        assert got.get(i, []) == list(enumerate(scan(s or ""), 1)), s


def test_packed_very_long(spark):
    words = [f"w{i}" for i in range(20_000)]
    quoted = '"' + "x;" * 200_000 + '"'
    df = spark.createDataFrame([(1, "|".join(words)), (2, quoted)], "row_id int, synonyms string")
    rows = packed.split_packed(df, "synonyms", ["row_id"]).collect()
    assert [r.value for r in rows if r.row_id == 1] == words
    assert [r.value for r in rows if r.row_id == 2] == [quoted[1:-1]]
    assert packed.split_packed(df.limit(0), "synonyms", ["row_id"]).count() == 0


def agree(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, synonyms string")
    got = {i: [] for i in range(len(texts))}
    for r in packed.split_packed(df, "synonyms", ["row_id"]).orderBy("row_id", "pos").collect():
        got[r.row_id].append(r.value)
    for i, t in enumerate(texts):
        assert got[i] == scan(t), t


def test_packed_equals_scan_on_random_texts(spark):
    r = random.Random(5)
    agree(spark, ["".join(r.choice("ab'\";,|\\ “”[]{}(-") for _ in range(r.randint(0, 16))) for _ in range(6000)])
    agree(spark, ["".join(r.choice("a'\", \\") for _ in range(r.randint(0, 24))) for _ in range(6000)])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab'\";,|\\ “”[]{}(-\t\n\xa0\ue000\ue002é", max_size=14), min_size=25, max_size=25))
def test_packed_equals_scan(spark, texts):
    agree(spark, texts)


GOOD = ["en,w,noun,c,a gloss,true,canonical,1,,,s,l:1,high,reviewed", 'en,w,noun,c,"a, ""b""\nc",1,x,,,,s,l, LOW,"Reviewed"', "﻿en,w,n,c,ok,1,x,1,,,s,l,medium,REJECTED "]
BAD = [
    (None, "column_count"), ("", "column_count"), ("a,b", "column_count"), (GOOD[0] + ",", "column_count"), (GOOD[0].replace("a gloss", 'a "gloss"'), "quoting"), (GOOD[0].replace("a gloss", '"a gloss'), "quoting"),
    (GOOD[0].replace("a gloss", ' "a gloss"'), "quoting"), (GOOD[0].replace("a gloss", '"a" gloss'), "quoting"), (GOOD[0].replace("a gloss", '"a \\"b\\" c"'), "quoting"), (GOOD[0].replace("high", "hgih"), "invalid_value"),
    (GOOD[0].replace("a gloss", "..."), "invalid_value"), (GOOD[0].replace("a gloss", "a\tb"), "invalid_value"), (GOOD[0].replace("a gloss", "a\x00b"), "invalid_value"), (GOOD[0].replace("a gloss", "a�b"), "invalid_value"),
    (GOOD[0].replace("reviewed", ""), "invalid_value"), (GOOD[0].replace("a gloss", "a\x85b"), "invalid_value"), ("a,b,\"", "quoting"), ('\ufeff"en"' + GOOD[0][2:], "quoting"),
]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_failing_rows(spark, block):
    lines = [(g, None) for g in GOOD] * 5 + BAD + [(g, None) for g in GOOD] + [(GOOD[0].replace("a gloss", "x" * 300_000), None)]
    df = spark.createDataFrame([(i, r, "clash") for i, (r, _) in enumerate(lines)], "line_id long, raw_line string, gloss string").coalesce(1)
    got = {r.line_id: r.reason for r in quarantine.load_records(df, block_rows=block).collect()}
    assert got == {i: w for i, (_, w) in enumerate(lines)}


def test_valid_rows_are_typed(spark):
    df = spark.createDataFrame([(1, GOOD[1]), (2, "x")], "line_id long, raw_line string")
    rows = quarantine.valid_word_senses(quarantine.load_records(df)).collect()
    marked = quarantine.load_records(spark.createDataFrame([(1, GOOD[2])], "line_id long, raw_line string")).collect()
    assert [(r.reason, r.language_code) for r in marked] == [(None, "en")]
    assert [(r.line_id, r.gloss, r.is_primary, r.sense_rank, r.confidence, r.review_status) for r in rows] == [(1, 'a, "b"\nc', True, None, "low", "reviewed")]
    assert quarantine.load_records(df.limit(0)).count() == 0


def test_most_good_records_are_loaded_by_columns(tiny):
    import pyarrow.parquet as pq

    records = pq.read_table(f"{tiny}/word_senses_csv.parquet")["raw_line"].combine_chunks()
    rules = quarantine.RecordRules()
    _, at, alone = quarantine.Blocks(records, rules).isolate(quarantine.BLOCK_ROWS)
    good = [i for i, x in enumerate(records.to_pylist()) if quarantine.diagnose(x, rules)[0] is None]
    assert set(at) <= set(good) and len(at) > 0.98 * len(good)
    assert len(at) + len(alone) == len(records)


def test_nested_records(spark, tmp_path):
    deep = {"a": 1}
    for _ in range(300):
        deep = {"parents": [deep]}
    records = [
        (1, json.dumps({"tags": ["x"], "synonyms": [None, {"word": "s"}, 3, {"word": "t"}], "categories": {"name": "c", "parents": {"name": "p"}}}), ["a", None, " ", "b"]),
        (2, json.dumps(json.dumps({"place": {"grid": {"x": 1}}, "source": [{"page": {"no": 2}}]})), None),
        (3, None, []), (4, "not json", ["z"]), (5, "[]", None), (6, json.dumps(deep), None), (7, "{}", None), (7, "{}", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in records], "id long, raw_sense string, raw_tags array<string>, node_path string")
    nodes = flatten.flatten_nodes(df, "id", "raw_sense", "raw_tags")
    got = sorted((r.id, r.parent_path, r.node_path) for r in nodes.collect() if r.id != 6 and r.table_tag != flatten.BAD_TABLE)
    assert got == sorted([
        (1, "", "synonyms[1]"), (1, "", "synonyms[3]"), (1, "", "categories[0]"), (1, "categories[0]", "categories[0].parents[0]"), (1, "", "raw_tags[0]"), (1, "", "raw_tags[3]"),
        (2, "", "place"), (2, "place", "place.grid"), (2, "", "source[0]"), (2, "source[0]", "source[0].page"), (4, "", "raw_tags[0]"),
    ])
    assert sorted(r.id for r in nodes.collect() if r.table_tag == flatten.BAD_TABLE) == [4, 5]
    assert nodes.filter("id = 6").count() == 300
    flatten.write_node_tables(nodes, str(tmp_path / "n"))
    syn = flatten.read_node_table(spark, str(tmp_path / "n"), "synonyms", "word string, sense string").collect()
    assert sorted((r.id, r.word) for r in syn) == [(1, "s"), (1, "t")]
    assert flatten.flatten_nodes(df.limit(0), "id", "raw_sense", "raw_tags").count() == 0
