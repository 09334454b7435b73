import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lexiweave.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


def _variant(tiny, out, columns):
    """The smallest tables, each column as ``columns`` gives it for (column, key)."""
    import duckdb

    keys = {"id", "doc_id", "row_id", "line_id", "vec_id", "sense_id", "event_id"}
    con = duckdb.connect()
    for p in sorted(Path(tiny).iterdir()):
        names = con.sql(f"SELECT * FROM '{p}' LIMIT 0").columns
        key = next((c for c in names if c in keys), names[0])
        con.execute(f"COPY (SELECT {', '.join(columns(c, key) for c in names)} FROM '{p}' {'WHERE false' if out.name == 'empty' else ''}) TO '{out}/{p.name}' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="session")
def nulled(tiny, tmp_path_factory):
    """The smallest tables with a third of every column null, but for the keys."""
    out = tmp_path_factory.mktemp("tables") / "nulled"
    out.mkdir()
    return _variant(tiny, out, lambda c, key: c if c == key else f"CASE WHEN hash({key}::VARCHAR || '{c}') % 3 = 0 THEN NULL ELSE {c} END AS {c}")


@pytest.fixture(scope="session")
def empty_tables(tiny, tmp_path_factory):
    """The tables without rows."""
    out = tmp_path_factory.mktemp("tables") / "empty"
    out.mkdir()
    return _variant(tiny, out, lambda c, key: c)
