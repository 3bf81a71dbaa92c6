"""The driver contract: registered queries, their SQL twins and the flagship query, on the smallest data."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from logsieve.plans.oracle import ORACLE  # noqa: E402
from logsieve.plans.queries import QUERIES  # noqa: E402

SF = Path("/root/testdata/sf0.001")
COMPARED = [
    "label_mix", "parse_log", "parse_text_log", "audit_patterns", "rule_coverage", "payload_coverage", "rule_false_block_listing_new", "feature_table", "lag_same_url",
    "split_stratified", "ban_interval_join", "layered_verdict", "threshold_sweep", "auc", "score_distribution", "macro_metrics",
]
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables not present")


def test_every_query_has_a_twin():
    """Those of the optional corpus operators have their own tests."""
    assert set(ORACLE) == set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert sum(r.n for r in rows) == 1000


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", COMPARED)
def test_twin_agrees(spark, name):
    con = duckdb.connect()
    for table in ("events", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = contract.queries()[name](spark, str(SF))
    twin = con.sql(contract.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(twin.columns)
    ours = [tuple(plain(r[c]) for c in names) for r in found.collect()]
    order = [twin.columns.index(c) for c in names]
    theirs = [tuple(plain(row[i]) for i in order) for row in twin.fetchall()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)
