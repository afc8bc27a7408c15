import pytest

pytest.importorskip("claimscope.llm")
from claimscope.llm import queries, sql  # noqa: E402
from tests.oracle import connection, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], sql.SQL[name], connection())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_without_repeated_rows(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = df.count()
    assert rows > 0
    if name.endswith("_found"):
        assert df.distinct().count() == rows
