import math
import random
import re
from collections import Counter

import pytest

from logsieve.llm import lexical

ITEMS = "item_id long, text string, n long, item long, score long"


def plain(docs, items, k=10):
    """Every document scored for every item; order of the items' rows by what they are."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 25 + (75 * c.total() * n_docs) // max(1, total)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], ITEMS)


def found(spark, documents, docs, items, **more):
    rows = lexical.search(documents([(i, t, None, None) for i, t in docs]), items_of(spark, items), **more).collect()
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_scoring_all(spark, documents, monkeypatch, seed):
    """Frequent and rare terms, repeats, blocks of a few documents, items of more than 64 and 128 terms."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 37)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 400)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(200)], k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(10)] + [(50, " ".join(vocabulary[:90])), (51, " ".join(vocabulary[:150])), (52, "nowhere"), (53, "W1 w1, w1")]
    assert found(spark, documents, docs, items) == plain(docs, items)


def test_odd_rows(spark, documents):
    docs = [(1, None), (2, ""), (3, " ..\n"), (4, "Ünï COLD cold"), (4, "Ünï COLD cold"), (None, "cold water"), (5, "x " * 5000 + "cold"), (6, "ünï")]
    items = [(1, "cold"), (1, "cold"), (2, None), (None, "water Ünï"), (3, "")]
    assert found(spark, documents, docs, items) == plain(docs, items)
    assert found(spark, documents, docs, items, k=1) == plain(docs, items, 1)


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, "a")]) == []
    assert found(spark, documents, [(1, "a")], []) == []


def test_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    from logsieve.llm.oracle import ORACLE
    from logsieve.llm.queries import QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    frame = QUERIES["op13_lexical_search"](spark, "/root/testdata/sf0.001")
    twin = con.sql(ORACLE["op13_lexical_search"])
    assert twin.columns == frame.columns
    assert sorted(map(str, twin.fetchall())) == sorted(str(tuple(r)) for r in frame.collect())
