import random
import zlib
from hashlib import sha256

import pytest

from logsieve.llm import conversation_trie as t

SCHEMA = "conv_id long, turn long, role string, text string, conv long, shard long, depth long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


def sequences(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(own)] for c, own in by.items()}


def plain(seq):
    if not seq:
        return set()
    nodes = {}
    for c, own in seq.items():
        for d in range(len(own) + 1):
            nodes.setdefault(tuple(own[:d]), []).append(c)
    children, out = {}, set()
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below) + (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        ends = ",".join(str(c) for c in sorted(nodes[key]) if len(seq[c]) == len(key))
        out.add((min(nodes[key]), len(key), min(nodes[key[:-1]]) if key else None, len(nodes[key]), len(below), leaves[key], saved[key], sha256(ends.encode()).hexdigest()))
    return out


def reopened(seq):
    out = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seq.get(c - c % 5, [])[:h] + own[h:]
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, convs=300, alphabet=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), convs):
        rows += [(c, i, rng.choice(["user", None]), rng.choice("abcdefgh"[:alphabet]) * 3) for i in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("limit", [4, 1 << 19])
def test_like_a_trie_in_memory(spark, monkeypatch, limit):
    """Many shared prefixes over several shards, queues that spill, digests in pieces, prefixes over several blocks."""
    monkeypatch.setattr(t, "TURNS", 3)
    monkeypatch.setattr(t, "PIECE", 2)
    rows = random_rows(1) + [(2000 + i, k, "user", "abc"[k % 3]) for i in range(40) for k in range(5)]
    seq = sequences(rows)
    assert found(t.conversation_trie(frame(spark, rows).repartition(8), limit)) == plain(seq)


def test_shared_openings(spark):
    rows = random_rows(2, longest=12) + [(7, 0, "user", "only"), (5000, 1, "user", "x"), (5003, 0, "user", "y")]
    assert found(t.shared_openings(frame(spark, rows))) == plain(reopened(sequences(rows)))


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(t, "TURNS", 50)
    rows = [(3, i, "user", "same") for i in range(1500)] + [(9, i, "user", "same") for i in range(700)] + [(1, 0, "user", "same")]
    assert found(t.conversation_trie(frame(spark, rows).repartition(8))) == plain(sequences(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, None, "user", "first"), (2, 5, "", ""), (-3, 1, "ü", "ü" * 50_000)]
    rows += [(4, 2, "user", "a"), (4, 2, "user", "a"), (4, 2, "b", "a")]
    got, want = found(t.conversation_trie(frame(spark, rows))), plain(sequences(rows))
    assert {r[:2] + r[3:] for r in got if r[0] != 4} == {r[:2] + r[3:] for r in want if r[0] != 4}
    assert sum(r[0] == 4 for r in got) == 3  # turns of one number: an order of their own
    assert found(t.shared_openings(frame(spark, []))) == set() == found(t.conversation_trie(frame(spark, [(None, 1, "a", "b")])))


def test_queue(tmp_path):
    rng = random.Random(4)
    queue, rest, taken = t.SpillingQueue(str(tmp_path / "runs"), 7, 2), [], []
    for _ in range(200):
        record = (rng.randint(0, 50), rng.randint(0, 5))
        queue.push(record)
        rest.append(record)
        if rng.random() < 0.1:
            bound = (rng.randint(0, 50), 0)
            taken = list(queue.pop_below(bound))
            assert taken == sorted(r for r in rest if r < bound)
            rest = [r for r in rest if r >= bound]
    assert list(queue.pop_below(None)) == sorted(rest)


def test_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    from logsieve.llm.oracle import ORACLE
    from logsieve.llm.queries import QUERIES

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = QUERIES["op12_conversation_trie"](spark, "/root/testdata/sf0.001")
    twin = con.sql(ORACLE["op12_conversation_trie"])
    assert twin.columns == df.columns
    assert sorted(map(str, twin.fetchall())) == sorted(map(str, found(df)))
