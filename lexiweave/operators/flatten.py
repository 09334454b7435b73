"""Deeply nested records turned into related flat tables.

One depth-first pass over a record emits, for each object in it, the table it
belongs to, its own key, its parent's key and its plain fields. The rows are
written partitioned by table, and each table gets its schema when it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of raw_sense that name arrays of objects; an object in an array's place is its element 0. Fixed values.
ARRAY_KEYS = (
    "categories", "parents", "synonyms", "antonyms", "derived", "related", "translations", "variants", "sounds",
    "examples", "form_of", "alt_of", "coordinate_terms", "hyponyms",
)
#: The table of the entries of a list of strings beside the record.
TAG_TABLE = "raw_tags"
#: The table of records that hold no object.
BAD_TABLE = "_unreadable"

_WORDS = "word string, sense string, tags array<string>, _dis1 string"
#: The fields of each table of raw_sense, in DDL.
SENSE_TABLES = {
    **dict.fromkeys(("synonyms", "antonyms", "derived", "related", "coordinate_terms", "hyponyms", "form_of", "alt_of"), _WORDS),
    "categories": "name string, kind string", "parents": "name string, depth int", "translations": "code string, word string, roman string", "variants": "form string, tags array<string>",
    "sounds": "ipa string, dialect string", "examples": "text string", "attestation": "year int", "place": "name string", "grid": "x int, y int", "source": "title string", "page": "no int",
}

NODE_SCHEMA = "table_tag string, node_path string, parent_path string, payload string"


def unwrapped(text: str) -> dict | None:
    """The record's object, out of any JSON strings or one-element lists around it; None where there is none."""
    try:
        o = json.loads(text)
        while isinstance(o, str) or (isinstance(o, list) and len(o) == 1):
            o = json.loads(o) if isinstance(o, str) else o[0]
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def visit(root: dict, array_keys: frozenset[str]) -> Iterator[tuple[str, str, str, str]]:
    """(table, path, parent's path, payload) of each object below the root, depth first, in the order of the text.

    The table is the key under which an object stands. The payload is the JSON
    of its plain fields, lists of plain values included; elements that are no
    objects keep their index, so the indexes count every element.
    """
    stack = [iter(_children(root, "", array_keys))]
    parents = [""]
    while stack:
        for tag, path, value in stack[-1]:
            yield tag, path, parents[-1], _payload(value)
            stack.append(iter(_children(value, path + ".", array_keys)))
            parents.append(path)
            break
        else:
            stack.pop()
            parents.pop()


def _children(o: dict, prefix: str, array_keys: frozenset[str]) -> list[tuple[str, str, dict]]:
    out = []
    for k, v in o.items():
        if type(v) is dict:
            out.append((k, f"{prefix}{k}[0]" if k in array_keys else prefix + k, v))
        elif type(v) is list:
            _elements(k, prefix + k, v, out)
    return out


def _elements(tag: str, path: str, items: list, out: list) -> None:
    for i, x in enumerate(items):
        if type(x) is dict:
            out.append((tag, f"{path}[{i}]", x))
        elif type(x) is list:
            _elements(tag, f"{path}[{i}]", x, out)


def _plain(v: object) -> bool:
    if type(v) is list:
        return not any(type(x) in (dict, list) for x in v)
    return type(v) is not dict


def _payload(o: dict) -> str:
    return json.dumps({k: v for k, v in o.items() if _plain(v)}, ensure_ascii=False, separators=(",", ":"))


def flatten_nodes(df: DataFrame, key: str, record: str | None, tags: str | None = None, array_keys: tuple[str, ...] = ARRAY_KEYS) -> DataFrame:
    """(key, table_tag, node_path, parent_path, payload): a row for each nested object and each tag.

    ``record`` is a column of JSON text, ``tags`` one of ARRAY<STRING> or null.
    A null record and null, empty or blank tags give no row; a text without an
    object gives one row of the table BAD_TABLE with the text as payload, so
    nothing is lost unseen. Repeated records give repeated rows. Only the named
    columns are read, so others may clash in name. Each record is visited once,
    where it lies: there is no shuffle.
    """
    known = frozenset(array_keys)
    cols = [F.col(key).alias("_key"), (F.col(record) if record else F.lit(None).cast("string")).alias("_record"), (F.col(tags) if tags else F.lit(None).cast("array<string>")).alias("_tags")]
    kept = df.select(*cols)
    key_type = kept.schema["_key"].dataType
    schema = T.StructType([T.StructField(key, key_type), *T._parse_datatype_string(NODE_SCHEMA).fields])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, table, path, parent, payload = [], [], [], [], []
            for i, (text, entries) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                n = len(path)
                if text is not None:
                    root = unwrapped(text)
                    if root is None:
                        table.append(BAD_TABLE), path.append(""), parent.append(""), payload.append(text)
                    else:
                        for t, p, q, v in visit(root, known):
                            table.append(t), path.append(p), parent.append(q), payload.append(v)
                for j, x in enumerate(entries or ()):
                    if x is not None and x.strip():
                        table.append(TAG_TABLE), path.append(f"{TAG_TABLE}[{j}]"), parent.append(""), payload.append(x)
                at.extend([i] * (len(path) - n))
            columns = [b.column(0).take(pa.array(at, pa.int32())), *[pa.array(x, pa.string()) for x in (table, path, parent, payload)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(nodes, schema)


def write_node_tables(nodes: DataFrame, path: str) -> None:
    """Writes the nodes as one folder a table."""
    nodes.write.mode("overwrite").partitionBy("table_tag").parquet(path)


def read_nodes(spark: SparkSession, path: str, key: str = "id bigint") -> DataFrame:
    """(key, node_path, parent_path, payload, table_tag): the rows of all tables of write_node_tables, the unreadable records left out."""
    rows = spark.read.schema(f"{key}, node_path string, parent_path string, payload string, table_tag string").parquet(path)
    return rows.filter(F.col("table_tag") != BAD_TABLE)


def read_node_table(spark: SparkSession, path: str, tag: str, fields: str, key: str = "id bigint") -> DataFrame:
    """(key, node_path, parent_path, fields): one table of write_node_tables under its schema; ``fields`` and ``key`` are DDL.

    Only the table's own folder is read. Keys of the payload outside the schema
    are left, values of another type are null; a table of which there are no
    rows is empty.
    """
    rows = read_nodes(spark, path, key).filter(F.col("table_tag") == tag).drop("table_tag")
    if tag == TAG_TABLE:
        return rows.withColumnRenamed("payload", "tag")
    schema = T._parse_datatype_string(fields)
    parsed = rows.withColumn("_o", F.from_json("payload", schema))
    return parsed.select(*[c for c in rows.columns if c != "payload"], *[F.col("_o")[f.name].alias(f.name) for f in schema.fields])
