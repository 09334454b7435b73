import gzip
import json

import pytest

from lexiweave.sources import external, readers, writers


def test_entries(spark, tmp_path):
    lines = [{"word": "a", "pos": "noun", "senses": [{"glosses": ["g"], "tags": ["t"], "categories": [{"name": "n", "kind": "k"}]}], "other": 1}, {"word": "b", "synonyms": [{"word": "c"}]}]
    text = "\n\n".join(json.dumps(x) for x in lines) + "\n \nnot json\n[1]\n"
    (tmp_path / "x.jsonl").write_text(text)
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write(text)
    for name in ("x.jsonl", "y.jsonl.gz"):
        rows = readers.read_entries(spark, str(tmp_path / name)).collect()
        assert [(r.word, r.is_json) for r in rows] == [("a", True), ("b", True), (None, False), (None, False)]
        assert rows[0].senses[0].categories[0].name == "n" and json.loads(rows[0].raw)["other"] == 1
        assert rows[1].synonyms[0].word == "c"


LMF = """<?xml version="1.0"?><LexicalResource><Lexicon>
<LexicalEntry id="e1"><Lemma writtenForm="red_fox" partOfSpeech="n"/><Sense id="s1" synset="y1"/><Sense id="s2" synset="y2"/></LexicalEntry>
<LexicalEntry id="e2"><Lemma writtenForm="vixen" partOfSpeech="n"/><Sense id="s3" synset="y1"/></LexicalEntry>
<Synset id="y1" ili="i1" partOfSpeech="n"><Definition>a fox</Definition><SynsetRelation relType="similar" target="y2"/></Synset>
<Synset id="y2" ili="" partOfSpeech="n"><Definition>fur</Definition></Synset></Lexicon></LexicalResource>"""


def test_wordnet(spark, tmp_path):
    (tmp_path / "w.xml").write_text(LMF)
    members, synsets, relations = readers.read_wordnet(spark, str(tmp_path / "w.xml"), "_")
    assert sorted((r.synset_id, r.sense_id, r.lemma) for r in members.collect()) == [("y1", "s1", "red fox"), ("y1", "s3", "vixen"), ("y2", "s2", "red fox")]
    assert sorted((r.synset_id, r.ili, r.definition) for r in synsets.collect()) == [("y1", "i1", "a fox"), ("y2", None, "fur")]
    assert [tuple(r) for r in relations.collect()] == [("y1", "similar", "y2")]
    terms = spark.createDataFrame([(" Vixen ",)], "lemma string")
    assert {r.lemma for r in readers.members_of_terms(members, terms).collect()} == {"red fox", "vixen"}
    assert readers.members_of_terms(members, terms, 0).count() == 0


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿slug,label,notes\na,"x, ""y""",\n" b ",z,n\n', encoding="utf-8")
    rows = readers.read_catalogue(spark, str(tmp_path / "c.csv"), ["slug", "label"], ["notes"]).collect()
    assert [tuple(r) for r in rows] == [("a", 'x, "y"', None), ("b", "z", "n")]
    with pytest.raises(ValueError, match="missing: .'kind'"):
        readers.read_catalogue(spark, str(tmp_path / "c.csv"), ["slug", "label", "kind"], ["notes"])
    with pytest.raises(ValueError, match="unknown"):
        readers.read_catalogue(spark, str(tmp_path / "c.csv"), ["slug", "label"])
    (tmp_path / "d.csv").write_text("slug,label\na,b,c\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.read_catalogue(spark, str(tmp_path / "d.csv"), ["slug", "label"]).collect()


def test_small_readers(spark, tmp_path):
    assert readers.read_csv_or_empty(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "k.csv").write_text("a,b\n1,\n1,\n2,x\n")
    rows = readers.read_candidates(spark, str(tmp_path / "k.csv"), ["a", "b"]).collect()
    assert len(rows) == 3 and len({r.row_key for r in rows}) == 2
    (tmp_path / "u.txt").write_text("# x\nU+4E00\tkDefinition\tone; a\nU+4E00\tkOther\tz\nU+20000\tkDefinition\tsame as\n")
    assert sorted((r.code_point, r.character, r.definition) for r in readers.read_definitions(spark, str(tmp_path / "u.txt")).collect()) == [(0x4E00, "一", "one; a"), (0x20000, "\U00020000", "same as")]
    (tmp_path / "t.txt").write_text(" a \n\n#c\na\nb\n一二一x")
    assert sorted(r.lemma for r in readers.read_terms(spark, str(tmp_path / "t.txt")).collect()) == ["a", "b", "一二一x"]
    assert sorted(r.character for r in readers.read_characters(spark, str(tmp_path / "t.txt")).collect()) == ["一", "二"]
    (tmp_path / "m.json").write_text('{"a": 1}')
    assert readers.read_manifest(str(tmp_path / "m.json"), ("a",)) == {"a": 1}
    with pytest.raises(ValueError):
        readers.read_manifest(str(tmp_path / "m.json"), ("b",))
    (tmp_path / "s.jsonl").write_text('{"word": "a", "n": 1}\n{"word": "b"}\n')
    assert [tuple(r) for r in readers.read_json_lines(spark, str(tmp_path / "s.jsonl"), "word string, n int").collect()] == [("a", 1), ("b", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y', None), ("b", "line\nbreak", 2)], "k string, t string, n int")
    out = str(tmp_path / "o")
    writers.write_text(df, out, ["t", "k"], files=1)
    back = readers.read_csv_or_empty(spark, out, ["t", "k"])
    assert sorted(tuple(r) for r in back.collect()) == [("line\nbreak", "b"), ('x "q", y', "a")]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_text(df, out, ["t", "k"])
    writers.write_text(df, out, ["k"], "json", replace=True)
    with pytest.raises(ValueError):
        writers.write_text(df, out, ["zz"])
    part = str(tmp_path / "p")
    writers.replace_parts(spark.createDataFrame([(1, "a"), (2, "b")], "v int, g string"), part, ["g"])
    writers.replace_parts(spark.createDataFrame([(3, "b")], "v int, g string"), part, ["g"])
    assert sorted((r.v, r.g) for r in spark.read.parquet(part).collect()) == [(1, "a"), (3, "b")]


def test_external_calls(spark):
    def call(prompt):
        if prompt == "boom":
            raise RuntimeError
        return ["Fox", " "] if prompt == "ok" else []

    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "none"), (4, None)], "id long, prompt string")
    got = external.propose(df, "id", "prompt", call, gap=0.0).cache()
    assert sorted((r.id, r.status, r.proposals) for r in got.collect()) == [(1, "resolved", ["Fox"]), (2, "error", []), (3, "unresolved", [])]
    words = spark.createDataFrame([("fox", 10, 0.5), ("fox", 11, 0.9)], "word string, target_id long, score double")
    assert sorted(tuple(r) for r in external.settle(got, words, "id").collect()) == [(1, "resolved", 11, 0.9), (2, "error", None, None), (3, "unresolved", None, None)]
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "a")], "id long, text string")
    done = spark.createDataFrame([(2,)], "id long")
    vec = external.embed_missing(rows, done, "id", "text", lambda ts: [[float(len(t))] for t in ts]).collect()
    assert sorted((r.id, r.vector) for r in vec) == [(1, [1.0]), (4, [1.0])]
