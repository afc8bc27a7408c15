"""Every core query with SQL against DuckDB on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

from claimscope.plans import catalogue
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_points_without_llm():
    """In a process in which the subpackage can't be imported, exactly the core's queries are there."""
    code = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == "claimscope.llm" or name.startswith("claimscope.llm."):
            raise ImportError(name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
from claimscope.plans import catalogue
assert e.queries() == catalogue.QUERIES and e.oracle_sql() == catalogue.SQL
assert not [m for m in sys.modules if m.startswith("claimscope.llm")]
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
