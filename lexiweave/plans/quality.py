"""Queries of the general data problems: orphans, packed fields, failing rows, nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.durable import Scratch
from lexiweave.operators import flatten, orphans, packed, quarantine
from lexiweave.session import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    senses, links = table(spark, d, "word_senses"), table(spark, d, "concept_relationships")
    return orphans.reference_rows(senses, "word_senses", ["concept_slug"]).unionByName(
        orphans.reference_rows(links, "concept_relationships", ["source_concept_slug", "target_concept_slug"])
    )


def _ledger(spark: SparkSession, d: str) -> orphans.ReferenceLedger:
    return orphans.ledger_of(spark, _references(spark, d), orphans.existence_deltas(table(spark, d, "concepts")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).orphans().select("ref_table", "ref_field", "row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month of loading."""
    return orphans.orphans_by_period(_ledger(spark, d).orphans(), _references(spark, d))


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are orphans once all deltas are in: late records settle earlier references."""
    return orphans.current_orphans(_ledger(spark, d).counts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        packed.split_packed(table(spark, d, t), "synonyms", ["row_id"], "synonym").select(F.lit(t).alias("table_name"), "row_id", "pos", "synonym")
        for t in ("raw_entries", "raw_synsets")
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.rejected(quarantine.load_records(table(spark, d, "word_senses_csv")))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid records as typed rows."""
    return quarantine.valid_word_senses(quarantine.load_records(table(spark, d, "word_senses_csv")))


def _sense_tables(spark: SparkSession, d: str) -> str:
    """The folder of the flat tables of senses, written in one pass."""
    scratch = Scratch(spark, "nodes")
    flatten.write_node_tables(flatten.flatten_nodes(table(spark, d, "senses"), "id", "raw_sense", "raw_tags"), f"{scratch.root}/nodes")
    return f"{scratch.root}/nodes"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.read_nodes(spark, _sense_tables(spark, d)).select(F.col("id").alias("sense_id"), "parent_path", "node_path")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows at the root, and values of each flat table under its schema."""
    path, parts = _sense_tables(spark, d), []
    for tag, fields in [*flatten.SENSE_TABLES.items(), (flatten.TAG_TABLE, "")]:
        rows = flatten.read_node_table(spark, path, tag, fields)
        values = sum((F.count(c) for c in rows.columns[3:]), F.lit(0))
        parts.append(rows.agg(F.lit(tag).alias("table_tag"), F.count("*").alias("n_rows"), F.count(F.when(F.col("parent_path") == "", 1)).alias("n_top"), values.alias("n_values")))
    return reduce(DataFrame.unionByName, parts).filter("n_rows > 0")


def p6_translations(spark: SparkSession, d: str) -> DataFrame:
    """One of the flat tables: only its own folder is read."""
    return flatten.read_node_table(spark, _sense_tables(spark, d), "translations", flatten.SENSE_TABLES["translations"])


QUERIES = {
    f.__name__: f for f in (p2_found, p2_report, p2_ledger, p3_found, p4_found, p4_loaded, p6_found, p6_tables, p6_translations)
}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_REFS = f"""refs AS (
  SELECT 'word_senses' AS ref_table, 'concept_slug' AS ref_field, id AS row_id, {_KEY.format('concept_slug')} AS key, loaded_at AS seen FROM word_senses
  UNION ALL SELECT 'concept_relationships', 'source_concept_slug', id, {_KEY.format('source_concept_slug')}, loaded_at FROM concept_relationships
  UNION ALL SELECT 'concept_relationships', 'target_concept_slug', id, {_KEY.format('target_concept_slug')}, loaded_at FROM concept_relationships),
lives AS (SELECT {_KEY.format('slug')} AS key, loaded_at AS born, deleted_at AS died FROM concepts)"""
_ORPHANS = f"""{_REFS}, orphans AS (SELECT r.* FROM refs r WHERE r.key IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM lives c WHERE c.key = r.key AND c.born <= r.seen AND (c.died IS NULL OR c.died > r.seen)))"""
_FIELD = '(?:[^",]*|"(?:[^"]|"")*")'


def _nth_field(n: int) -> str:
    raw = rf"regexp_extract(line, '^(?:{_FIELD},){{{n}}}({_FIELD})(?:,{_FIELD}){{{13 - n}}}$', 1, 's')"
    return f"""CASE WHEN starts_with({raw}, '"') THEN replace({raw}[2:-2], '""', '"') ELSE {raw} END"""


_CSV = rf"""WITH lines AS (SELECT line_id, raw_line AS line FROM word_senses_csv),
shaped AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted_well, regexp_full_match(line, '{_FIELD}(?:,{_FIELD}){{13}}', 's') AS columns_right,
  {_nth_field(4)} AS gloss, lower(regexp_replace({_nth_field(12)}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS confidence,
  lower(regexp_replace({_nth_field(13)}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS review_status FROM lines),
judged AS (SELECT *, CASE WHEN line IS NULL THEN 'column_count' WHEN NOT quoted_well THEN 'quoting' WHEN NOT columns_right THEN 'column_count'
  WHEN confidence NOT IN ('high', 'medium', 'low') OR review_status NOT IN ('unreviewed', 'reviewed', 'rejected')
    OR NOT regexp_matches(gloss, '\p{{L}}') OR regexp_matches(gloss, '[\x{{fffd}}\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') THEN 'invalid_value' END AS reason FROM shaped)"""

_TEXTS = {0: "language_code", 1: "word_text", 2: "part_of_speech", 3: "concept_slug", 4: "gloss", 6: "equivalence_type", 8: "external_sense_id", 9: "external_synset_id", 10: "source_slug", 11: "source_locator"}
_LOADED = f"""{_CSV} SELECT line_id, {", ".join(f"nullif({f'ltrim({_nth_field(i)}, chr(65279))' if i == 0 else _nth_field(i)}, '') AS {c}" for i, c in _TEXTS.items() if c != 'gloss')}, nullif(gloss, '') AS gloss,
  CASE WHEN lower(trim({_nth_field(5)})) IN ('true', '1', 'yes') THEN true WHEN lower(trim({_nth_field(5)})) IN ('false', '0', 'no') THEN false END AS is_primary,
  TRY_CAST(trim({_nth_field(7)}) AS INTEGER) AS sense_rank, confidence, review_status FROM judged WHERE reason IS NULL"""

_D, _W = r",;|/\t\n\r，；、", r"[\s\p{Z}\x1c-\x1f\x85]"
#: One value and its delimiter: enclosed in quotes, or up to a delimiter that no backslash escapes.
_VALUE = rf"""{_W}*("(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.)*'|“(?:[^”\\]|\\.)*”|'(?:\\.|[^\\{_D}])*'|(?:\\.|[^\\{_D}])*){_W}*(?:[{_D}]|$)""".replace("'", "''")
_PACKED = rf"""SELECT table_name, row_id, generate_subscripts(vs, 1)::INTEGER AS pos, unnest(vs) AS synonym FROM (
  SELECT table_name, row_id, list_filter(list_transform(regexp_extract_all(CASE WHEN regexp_full_match(t, '\[.*\]|\{{.*\}}', 's') THEN t[2:-2] ELSE t END, '{_VALUE}', 1, 's'),
    lambda v: CASE WHEN regexp_full_match(v, '".*"', 's') THEN regexp_replace(replace(v[2:-2], '""', '"'), '\\(.)', '\1', 'gs')
      WHEN regexp_full_match(v, '''.*''|“.*”', 's') THEN regexp_replace(v[2:-2], '\\(.)', '\1', 'gs')
      ELSE trim(regexp_replace(v, '\\(.)', '\1', 'gs')) END), lambda v: v <> '') AS vs FROM (
    SELECT 'raw_entries' AS table_name, row_id, regexp_replace(synonyms, '^{_W}+|{_W}+$', '', 'g') AS t FROM raw_entries
    UNION ALL SELECT 'raw_synsets', row_id, regexp_replace(synonyms, '^{_W}+|{_W}+$', '', 'g') FROM raw_synsets))"""

_ARRAYS = "categories|parents|synonyms|antonyms|derived|related|translations|variants|sounds|examples|form_of|alt_of|coordinate_terms|hyponyms"


def _unwrap(j: str) -> str:
    return f"""CASE json_type({j}) WHEN 'VARCHAR' THEN CASE WHEN json_valid({j} ->> '$') THEN CAST({j} ->> '$' AS JSON) END WHEN 'ARRAY' THEN CASE WHEN json_array_length({j}) = 1 THEN {j} -> 0 END ELSE {j} END"""


def _indexed(p: str) -> str:
    """Names of arrays without an index get the index 0; twice, as neighbours share a point."""
    for _ in range(2):
        p = rf"regexp_replace({p}, '(^|\.)({_ARRAYS})(\.|$)', '\1\2[0]\3', 'g')"
    return p


#: Every object below the root, by the path of its own and of the object around it.
_TREE = rf"""WITH j0 AS (SELECT id, CASE WHEN json_valid(raw_sense) THEN CAST(raw_sense AS JSON) END AS j FROM senses), j1 AS (SELECT id, {_unwrap('j')} AS j FROM j0), j2 AS (SELECT id, {_unwrap('j')} AS j FROM j1),
j3 AS (SELECT id, {_unwrap('j')} AS j FROM j2), steps AS (SELECT s.id, t.key AS k, t.type AS type, t.value AS value, substr(t.fullkey, 3) AS spot FROM j3 s, json_tree(s.j) t WHERE json_type(s.j) = 'OBJECT' AND t.fullkey <> '$'),
objects AS (SELECT id, spot, regexp_extract(spot, '([^.\[]*)(?:\[\d+\])*$', 1) AS tag, {_indexed('spot')} AS node_path, {_indexed(r"regexp_replace(spot, '\.?[^.]*$', '')")} AS parent_path, value FROM steps WHERE type = 'OBJECT'),
tags AS (SELECT id, 'raw_tags[' || (i - 1) || ']' AS node_path, '' AS parent_path FROM (SELECT id, raw_tags, unnest(generate_series(1, len(raw_tags))) AS i FROM senses) WHERE trim(coalesce(raw_tags[i], '')) <> '')"""

SQL = {
    "p3_found": _PACKED,
    "p2_found": f"WITH {_ORPHANS} SELECT ref_table, ref_field, row_id FROM orphans",
    "p2_report": f"""WITH {_ORPHANS},
t AS (SELECT ref_table, ref_field, strftime(seen, '%Y-%m') AS period, count(*) AS n_refs FROM refs WHERE key IS NOT NULL GROUP BY ALL),
b AS (SELECT ref_table, ref_field, strftime(seen, '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT key) AS n_orphan_keys FROM orphans GROUP BY ALL)
SELECT t.*, coalesce(b.n_orphans, 0) AS n_orphans, coalesce(b.n_orphan_keys, 0) AS n_orphan_keys FROM t LEFT JOIN b
ON t.ref_table = b.ref_table AND t.ref_field = b.ref_field AND t.period IS NOT DISTINCT FROM b.period""",
    "p2_ledger": f"""WITH {_REFS} SELECT key, count(*) AS refs FROM refs WHERE key IS NOT NULL
AND key NOT IN (SELECT key FROM lives WHERE key IS NOT NULL AND born IS NOT NULL AND died IS NULL) GROUP BY key""",
    "p4_loaded": _LOADED,
    "p6_found": f"{_TREE} SELECT id AS sense_id, parent_path, node_path FROM objects UNION ALL SELECT id, parent_path, node_path FROM tags",
    "p6_tables": f"""{_TREE}, fields AS (SELECT o.id, o.spot, o.tag, count(f.key) FILTER (f.type NOT IN ('NULL', 'OBJECT') AND NOT (f.type = 'ARRAY' AND len(list_filter(json_extract(f.value, '$[*]'), lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))) > 0)) AS n
  FROM objects o LEFT JOIN LATERAL (SELECT * FROM json_each(o.value)) f ON true GROUP BY o.id, o.spot, o.tag)
SELECT tag AS table_tag, count(*) AS n_rows, count(*) FILTER (parent_path = '') AS n_top, CAST(sum(n) AS BIGINT) AS n_values FROM objects JOIN fields USING (id, spot, tag) GROUP BY tag
UNION ALL SELECT 'raw_tags', count(*), count(*), count(*) FROM tags HAVING count(*) > 0""",
    "p6_translations": f"""{_TREE} SELECT id, node_path, parent_path, value ->> 'code' AS code, value ->> 'word' AS word, value ->> 'roman' AS roman FROM objects WHERE tag = 'translations'""",
    "p4_found": f"{_CSV} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
}
