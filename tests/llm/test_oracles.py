"""Queries with SQL: the same rows and types as DuckDB on the smallest tables."""
import pytest

from moldwatch.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.test_oracle import SPARK_TO_DUCK
from tools.oracle_check import duck_connect, rows_of


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == types
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
