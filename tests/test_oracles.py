"""A spread of registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import rows
from demo.views import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
SPREAD = [
    "normalise_grade", "norm_name", "opportunity_scores", "sectionise", "apply_guards", "match_by_name", "apply_snapshot",
    "survivorship", "evidence_coverage", "opportunity_export",
]


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry(spark):
    assert "critical_signals" in entry(spark).columns


@pytest.mark.parametrize("name", SPREAD)
def test_query(spark, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())
