import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from lexiweave import plans

CORE = {k: f for m in plans.modules() for k, f in m.QUERIES.items()}
SQL = {k: s for m in plans.modules() for k, s in m.SQL.items()}


def test_names_agree():
    assert set(SQL) <= set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tiny, name):
    from oracle_check import compare, connect

    rel = connect(tiny).sql(SQL[name])
    assert compare(CORE[name](spark, tiny), list(rel.columns), rel.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_with_nulls_equals_its_sql(spark, nulled, name):
    from oracle_check import compare, connect

    rel = connect(nulled).sql(SQL[name])
    assert compare(CORE[name](spark, nulled), list(rel.columns), rel.fetchall()) == ""


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, nulled, name):
    assert CORE[name](spark, tiny).count() > 0
    rows = CORE[name](spark, nulled)
    assert rows.columns == CORE[name](spark, tiny).columns and rows.count() <= 10 * CORE[name](spark, tiny).count()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_over_empty_tables(spark, empty_tables, name):
    rows = CORE[name](spark, empty_tables).collect()
    assert all(v in (0, None) or isinstance(v, str) for r in rows for v in r), rows[:3]


def test_core_stands_without_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "lexiweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lexiweave.llm" not in p.read_text(), p
    code = "import sys; sys.modules['lexiweave.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
