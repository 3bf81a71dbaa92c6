import math
from pathlib import Path

import pytest

import corpus_pipeline
from logsieve.llm.oracle import ORACLE
from logsieve.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")


@pytest.fixture
def folder(spark, documents, tmp_path):
    def make(rows, items=((1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),)):
        documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_stages_take_effect(spark, folder):
    words = "the quick brown fox jumps over a lazy dog while birds sing in tall trees near water".split()
    text = lambda k: " ".join(words[(i * (k + 3)) % len(words)] + ("s" * (i % (k + 2))) for i in range(60))
    rows = [(k, text(k), "en", f"s{k % 3}") for k in range(20)]
    rows += [(30, "12345 67890", "en", "s1"), (31, text(4), "en", "s0"), (32, None, "en", "s0")]
    rows += [(33, text(40) + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " + text(41), "en", "s0")]
    sf = folder(rows)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language") == {*range(20), 31, 33}
    assert ids("near_duplicates") == {*range(20), 33} and ids("decontamination") == set(range(20))
    assert ids("mixing") <= set(range(20)) and len(seen["mixing"]) > 20
    assert sorted(r.doc_id for r in seen["token_output"]) == sorted(r.doc_id for r in seen["mixing"])
    out = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, seen["token_output"]))


def test_pipeline_over_nothing(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).collect() == []


def plain(value):
    return round(value, 5) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found, twin = QUERIES[name](spark, str(SF)), con.sql(ORACLE[name])
    names = sorted(found.columns)
    assert names == sorted(twin.columns)
    place = [twin.columns.index(c) for c in names]
    ours = [tuple(plain(r[c]) for c in names) for r in found.collect()]
    theirs = [tuple(plain(r[i]) for i in place) for r in twin.fetchall()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)
