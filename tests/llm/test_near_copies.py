import random

import corpus_pipeline
from logsieve.llm import near_copies, simhash


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def changed(words, times, rng):
    words = list(words)
    for at in rng.sample(range(10, len(words) - 10), times):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_pairs_from_similarity_four_fifths_on(spark, documents):
    """Later near copies go whatever their distance in SimHash bits; pairs below 0.8 stay."""
    rng = random.Random(5)
    rows, near, far = [], 0, set()
    for k in range(150):
        words = [f"w{k}x{rng.randrange(10_000)}" for _ in range(200)]
        copy = changed(words, rng.choice([1, 3, 4, 6, 8]), rng)
        rows += [(2 * k, " ".join(words), "en", "a"), (2 * k + 1, copy, "en", "a")]
        if jaccard(" ".join(words), copy) < 0.8:
            far.add(2 * k + 1)
        else:
            near += (simhash.fingerprint(rows[-2][1]) ^ simhash.fingerprint(copy)).bit_count() > 3
    assert near > 20 and len(far) > 20
    kept = corpus_pipeline.without_near_duplicates(spark, documents(rows), "")
    assert kept.columns == documents().columns
    assert {r.doc_id for r in kept.collect()} == {*range(0, 300, 2)} | far


def test_chains_hot_classes_and_odd_rows(documents):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, changed(words, 2, rng), "en", "a") for i in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(60, 80):
        chain[10 * (i - 60)] = f"new{i}"
        rows.append((i, " ".join(chain), "en", "a"))
    kept = near_copies.one_per_class(documents(rows)).collect()
    assert {r.doc_id for r in kept} == {0, 60}
    kept = near_copies.one_per_class(documents()).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 5, 6]
    nameless = [(None, t, None, None) for t in ("a b c d e f", "g h i j k l", "a b c d e f")]
    assert sorted(r.text for r in near_copies.one_per_class(documents(nameless)).collect()) == ["a b c d e f", "g h i j k l"]
    assert near_copies.one_per_class(documents([])).collect() == []


def test_blocks_lose_no_pair(spark, documents, monkeypatch):
    """A dense group around the threshold, where pairs are on either side of it: like all pairs, whatever the blocks."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, changed(base, rng.choice([2, 3, 4, 5]), rng), "en", "a") for i in range(90)]
    parent = list(range(90))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(90):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i for i in range(90) if top(i) == i}
    assert 1 < len(want) < 80
    for few, many in ((3, 7), (256, 4096)):
        monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.WORDS, near_copies.LEAST_JACCARD, few, many))
        assert {r.doc_id for r in near_copies.one_per_class(documents(rows)).collect()} == want


def test_columns_of_any_name_stay(documents):
    kept = near_copies.one_per_class(documents())
    assert kept.columns == documents().columns and {(r._copies, r._place, r.row, r.place) for r in kept.collect()} == {(1, 4, 8, 9)}


def test_fingerprints_reach_what_no_band_does(documents):
    """Pairs of similarity 0.8 that share no band and lie at most 3 bits apart go by their SimHash class."""
    rows = []
    for k, seed in enumerate((10918, 76490, 165913)):
        words = [f"w{seed}x{i}" for i in range(13)]
        pair = " ".join(words), " ".join([*words[:-1], "new"])
        assert jaccard(*pair) == 0.8
        assert (simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count() <= simhash.MAX_DISTANCE
        bands = [near_copies.band_keys(near_copies.shingles(t)) for t in pair]
        assert not (bands[0] == bands[1]).any()
        rows += [(2 * k, pair[0], "en", "a"), (2 * k + 1, pair[1], "en", "a")]
    assert {r.doc_id for r in near_copies.one_per_class(documents(rows)).collect()} == {0, 2, 4}


def test_near_fingerprints_are_no_reason_alone(spark, documents):
    """A SimHash class only names candidates: texts of less than the similarity stay."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 6:
        words = [f"w{rng.random()}" for _ in range(60)]
        pair = " ".join(words), " ".join([*words[:28], f"new{rng.random()}", *words[29:44], f"new{rng.random()}", *words[45:]])
        if (simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count() <= simhash.MAX_DISTANCE:
            assert jaccard(*pair) < 0.8
            rows += [(len(rows), pair[0], "en", "a"), (len(rows) + 1, pair[1], "en", "a")]
    assert {r.doc_id for r in near_copies.one_per_class(documents(rows)).collect()} == set(range(6))
