import duckdb
import pytest

from sparkloom.plans.registry import ORACLES, QUERIES
from tests.compare import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    tables(c, SF)
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    said = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert said is None, said


@pytest.mark.parametrize("name", ["links_npmi", "lag_candidates", "bm25", "dedup_pairs", "causal_chains"])
def test_larger_tables(spark, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    tables(c, "/root/testdata/sf0.01")
    said = compare(spark, c, name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01")
    assert said is None, said
