import pytest

from lexiweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, tiny, nulled, name):
    from oracle_check import compare, connect

    for d in (tiny, nulled):
        rel = connect(d).sql(queries.SQL[name])
        assert compare(queries.QUERIES[name](spark, d), list(rel.columns), rel.fetchall()) == "", d


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, tiny, nulled, name):
    for d in (tiny, nulled):
        assert queries.QUERIES[name](spark, d).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_over_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == 0


def test_roundtrip(spark, tiny):
    assert queries.p8_roundtrip(spark, tiny).filter("NOT same").count() == 0


def test_documents_are_segmented_as_labelled(spark, tiny):
    """Most labelled documents of one segment have the language of their label; the data mislabel some."""
    found = {r.doc_id for r in queries.p10_found(spark, tiny).collect()}
    n = queries.p10_documents(spark, tiny).count()
    assert len(found) < 0.5 * n
