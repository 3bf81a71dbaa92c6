import itertools
import random

import numpy as np
import xxhash

from logsieve.llm import simhash
from logsieve.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{id: smallest id reachable} by comparing all pairs."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_fingerprint_bits():
    for text in ["", "One", "one two", "A b c d e f a b c", "é È x\x0by z", " ".join(map(str, range(500)))]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def clustered(seed, n=400):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(20)]
    while len(out) < n:
        fp = rng.choice(out)
        for _ in range(rng.randint(1, 5)):
            fp ^= 1 << rng.randrange(64)
        out.append(fp)
    return dict(enumerate(dict.fromkeys(out)))


def linked(spark, fps, most):
    signed = {i: int(np.uint64(f).astype(np.int64)) for i, f in fps.items()}
    points = spark.createDataFrame([(f, i) for i, f in signed.items()], "fp long, rep long")
    found = {r.node: r.component for r in components(simhash.links(points, most)).collect()}
    return {i: found.get(i, i) for i in fps}


def test_components_equal_all_pairs(spark):
    for seed in (1, 2):
        fps = clustered(seed)
        assert linked(spark, fps, 2048) == plain_components(fps)


def test_hot_buckets_lose_no_link(spark):
    """With a bucket size of 2 nearly all points take the finer blocks."""
    fps = clustered(3, 120)
    assert linked(spark, fps, 2) == plain_components(fps)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[1000 + i] for i in range(200)} == {1000}
    assert components(links.limit(0)).count() == 0


def test_odd_rows(spark, documents):
    rows = simhash.near_duplicates(documents()).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == "0" * 16 and by[1][0].component_id == by[2][0].component_id == by[3][0].component_id == 1
    assert by[6][0].component_id == by[7][0].component_id == 6 and by[6][0].class_size == 3
    assert all(r.fingerprint == f"{plain_fingerprint('one'):016x}" for r in by[5])
    assert simhash.near_duplicates(documents([])).count() == 0


def test_one_per_class(spark, documents):
    kept = simhash.one_per_class(documents())
    assert kept.columns == documents().columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6]
    nameless = [(None, "first text of all here", None, None), (None, "quite another one is this", None, None), (None, "first text of all here", None, None)]
    assert sorted(r.text for r in simhash.one_per_class(documents(nameless)).collect()) == ["first text of all here", "quite another one is this"]
