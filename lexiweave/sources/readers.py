"""Readers of dictionary dumps, wordnets, catalogues and lists.

All are lazy scans; a reader never opens a file in the driver, but for the
header of a catalogue and the small manifest.
"""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.functions.keys import trimmed

_LINK = "array<struct<word:string,sense:string,_dis1:string>>"
_RELATIONS = ("synonyms", "antonyms", "hypernyms", "hyponyms", "coordinate_terms", "derived", "related")
#: The parts of a dictionary dump's entry that are read by name; fixed values. The whole record stays beside them.
ENTRY_SCHEMA = (
    "word string, pos string, lang string, lang_code string, etymology_number string, etymology_text string, senses array<struct<glosses:array<string>,raw_glosses:array<string>,tags:array<string>,"
    "categories:array<struct<name:string,kind:string>>,alt_of:array<struct<word:string>>,form_of:array<struct<word:string>>,translations:array<struct<code:string,lang_code:string,word:string,roman:string,sense:string,_dis1:string>>,"
    + ",".join(f"{r}:{_LINK}" for r in _RELATIONS) + ">>, forms array<struct<form:string,roman:string,tags:array<string>,source:string>>, " + ", ".join(f"{r} {_LINK}" for r in _RELATIONS)
)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON-lines dump, gzip or not: the fields of ENTRY_SCHEMA, ``raw`` (the whole record as text) and ``is_json``.

    Blank lines are left out. A line that is no JSON object has null fields
    and is_json false. A gzip file is read by one task, as the format has it.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    o = F.from_json("value", T._parse_datatype_string(ENTRY_SCHEMA))
    ok = F.coalesce(F.try_parse_json("value").isNotNull() & (F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")), F.lit(False))
    return lines.select(o.alias("o"), F.col("value").alias("raw"), ok.alias("is_json")).select("o.*", "raw", "is_json")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file under the schema; what is no JSON has null fields."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


LEXICAL_ENTRY = "_id string, Lemma struct<_writtenForm:string,_partOfSpeech:string>, Sense array<struct<_id:string,_synset:string>>"
SYNSET = "_id string, _ili string, _partOfSpeech string, Definition array<string>, SynsetRelation array<struct<_relType:string,_target:string>>"


def read_wordnet(spark: SparkSession, path: str, join_marker: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, synsets, relations) of a wordnet in LMF, gzip or not.

    members: synset_id, sense_id, lemma, pos; ``join_marker``, where given, is
    what joins the words of a lemma and becomes a space. synsets: synset_id,
    ili (null where empty), pos, definition. relations: synset_id, rel_type,
    target_id.
    """
    entry = spark.read.format("xml").option("rowTag", "LexicalEntry").schema(LEXICAL_ENTRY).load(path)
    synset = spark.read.format("xml").option("rowTag", "Synset").schema(SYNSET).load(path)
    lemma = F.col("Lemma._writtenForm")
    if join_marker:
        lemma = F.replace(lemma, F.lit(join_marker), F.lit(" "))
    members = entry.select(trimmed(lemma).alias("lemma"), F.col("Lemma._partOfSpeech").alias("pos"), F.explode("Sense").alias("s")).select(F.col("s._synset").alias("synset_id"), F.col("s._id").alias("sense_id"), "lemma", "pos").filter("lemma <> ''")
    synsets = synset.select(F.col("_id").alias("synset_id"), F.nullif(F.trim("_ili"), F.lit("")).alias("ili"), F.col("_partOfSpeech").alias("pos"), F.try_element_at("Definition", F.lit(1)).alias("definition"))
    relations = synset.select(F.col("_id").alias("synset_id"), F.explode("SynsetRelation").alias("r")).select("synset_id", F.col("r._relType").alias("rel_type"), F.col("r._target").alias("target_id"))
    return members, synsets, relations


def members_of_terms(members: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """The synsets that hold any of the terms (lemma), all their members; with a limit, of the first so many synsets by id."""
    hit = members.join(terms.select(F.lower(trimmed("lemma")).alias("_t")), F.lower("lemma") == F.col("_t"), "left_semi").select("synset_id").distinct()
    if limit is not None:
        hit = hit.orderBy("synset_id").limit(limit)
    return members.join(hit, "synset_id", "left_semi")


def read_catalogue(spark: SparkSession, path: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """A curated CSV file with a header: all columns as text, blank ones null.

    A byte order mark is no part of the header. Missing required columns,
    unknown columns and a missing file are errors at once; a row with more or
    fewer values than the header is one when it is read.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"{path} is empty")
    first = _header(head[0].value)
    missing, odd = [c for c in required if c not in first], [c for c in first if c not in [*required, *(optional or [])]]
    if missing or odd:
        raise ValueError(f"{path}: columns missing: {missing}, unknown: {odd}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in first])
    rows = spark.read.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST", multiLine=True, escape='"').csv(path)
    return rows.select(*[F.nullif(trimmed(c), F.lit("")).alias(c) for c in first])


def _header(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]))]


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of text columns; no rows where there is no file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def read_candidates(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of text columns with ``row_key``, a stable key of a row's content and file."""
    df = read_csv_or_empty(spark, path, columns)
    return df.withColumn("row_key", F.xxhash64(F.input_file_name(), *[F.coalesce(c, F.lit("\0")) for c in columns]))


def read_definitions(spark: SparkSession, path: str, field: str = "kDefinition") -> DataFrame:
    """(code_point, character, definition) of a character database in tab-separated lines; comments and other fields are left out."""
    t = spark.read.text(path).filter("value LIKE 'U+%'").select(F.split("value", "\t").alias("p")).filter((F.size("p") >= 3) & (F.col("p")[1] == field))
    code = F.conv(F.substring(F.col("p")[0], 3, 6), 16, 10).cast("int")
    return t.select(code.alias("code_point"), F.decode(F.unhex(F.lpad(F.conv(F.substring(F.col("p")[0], 3, 6), 16, 16), 8, "0")), "UTF-32").alias("character"), F.col("p")[2].alias("definition"))


def read_characters(spark: SparkSession, path: str, ranges: str = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]") -> DataFrame:
    """(character): the different characters of the ranges in any text files."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(ranges), F.lit(0))).alias("character")).distinct()


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(lemma): the terms of a list, one a line; blank lines and comments left out."""
    return spark.read.text(path).select(trimmed("value").alias("lemma")).filter("lemma <> '' AND NOT startswith(lemma, '#')").distinct()


def read_manifest(path: str, required: tuple[str, ...] = ()) -> dict:
    """The one small JSON object that describes an extraction."""
    with open(os.fspath(path), encoding="utf-8") as f:
        m = json.load(f)
    missing = [k for k in required if k not in m]
    if missing:
        raise ValueError(f"{path}: missing {missing}")
    return m

