"""Every registered query against its DuckDB twin (sf0.001, whole tables)."""

import pytest

from __spark_entry__ import entry
from tools.compare import compare, duck
from vigil.plans.catalog import ORACLE, QUERIES

from .conftest import SF_SMALL

NO_SQL = {"mlp_holdout_eval"}  # iterative trainer


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_but_iterative_ones_has_sql():
    assert set(QUERIES) - set(ORACLE) == NO_SQL


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF_SMALL, name, QUERIES[name], ORACLE[name])
    assert r["schema"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values"], r


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["client", "revenue", "cost", "orders", "clicks", "impressions", "roas"]
    assert len(rows) == 5
    for r in rows:
        for m in df.columns[1:]:
            assert r[m][:2].isdigit()
