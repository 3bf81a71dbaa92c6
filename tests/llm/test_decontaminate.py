import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.llm import decontaminate

RNG = random.Random(4)
COMMON = "the of and to in a is that it was".split()


def prose(n, rng=RNG):
    return [rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


ITEMS = {i: prose(n) for i, n in enumerate([15, 25, 40, 60, 160])}


def reworded(words):
    return [w if k % 4 else f"other{k}" for k, w in enumerate(words)]


def planted():
    rows, truth = [], set()
    for i, words in ITEMS.items():
        for k, form in enumerate((words, reworded(words))):
            doc = 10 * i + k
            rows.append((doc, " ".join([*prose(70), *form, *prose(90)]) + ".", "en", "a"))
            truth.add((doc, i))
    rows += [(1000 + d, " ".join(prose(200)), "en", "a") for d in range(40)]
    # half of an item alone is no leak
    rows.append((2000, " ".join([*prose(60), *ITEMS[3][:20], *prose(60)]), "en", "a"))
    return rows, truth


@pytest.fixture
def benchmark(spark):
    rows = [(i, " ".join(w)) for i, w in ITEMS.items()] + [(90, ""), (91, None), (None, "no id"), (0, "z" * 9)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_planted_items_are_found_and_no_others(documents, benchmark):
    rows, truth = planted()
    found = decontaminate.contaminated(documents(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    kept = decontaminate.clean(documents(rows), benchmark)
    assert kept.columns == documents().columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in truth}


def test_parts_of_a_large_benchmark(documents, benchmark):
    rows, truth = planted()
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(rows), benchmark, rank=3).collect()} == truth


def test_odd_rows(spark, documents, benchmark):
    assert decontaminate.contaminated(documents(), benchmark).collect() == []
    assert decontaminate.contaminated(documents([]), benchmark).collect() == []
    assert decontaminate.contaminated(documents(), benchmark.limit(0)).collect() == []
    leak = " ".join(ITEMS[2])
    found = decontaminate.contaminated(documents([(None, leak, None, None), (3, leak, None, None), (3, leak, None, None)]), benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 2), (3, 2)]
    assert decontaminate.clean(documents([(None, leak, None, None), (4, None, None, None)]), benchmark).count() == 1


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == table[-1][-1]


def test_svd_spans_the_leading_space(spark):
    rng = np.random.default_rng(0)
    matrix = rng.standard_normal((60, 6)) @ rng.standard_normal((6, 40)) + 0.001 * rng.standard_normal((60, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in matrix], "ids array<int>, weights array<double>").repartition(4)
    found = decontaminate.randomised_svd(rows, 40, 6)
    exact = np.linalg.svd(matrix)[2][:6].T
    assert np.allclose(np.abs(np.linalg.svd(found.T @ exact)[1]), 1, atol=1e-3)


def test_recall_against_exact_cosines(spark):
    """Windows whose exact TF-IDF cosine with a passage is above the threshold are candidates."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    index = decontaminate.build_index(docs, items)
    weight = {w: index.squares[i] ** 0.5 for w, i in index.place.items()}

    def vector(words):
        return {w: n * weight[w] for w, n in Counter(words).items() if w in weight}

    def cosine(a, b):
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(w, 0) for w, v in a.items()) / norm if norm else 0

    wanted = got = 0
    passages = [(k, vector(p)) for k, words in items.items() for p in decontaminate.passages_of(words)]
    for row in docs.where("doc_id % 5 = 0 or doc_id in (29, 37, 39, 79)").collect():
        words = decontaminate.words_of(row.text)
        near = index.near(words)
        for start in range(0, max(1, len(words) - decontaminate.WINDOW // 2), decontaminate.WINDOW // 2):
            window = vector(words[start : start + decontaminate.WINDOW])
            for key, passage in passages:
                if cosine(window, passage) >= decontaminate.CANDIDATE_COSINE + 0.05:
                    wanted += 1
                    got += start in near.get(key, {})
    assert wanted > 5 and got >= 0.95 * wanted


def test_every_whole_item_is_found(spark):
    """Documents of the test tables that hold all words of an item in a row are leaks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    line = lambda words: b" " + b" ".join(words) + b" "
    whole = {r.item_id: line(decontaminate.words_of(r.text)) for r in items.collect()}
    texts = [(r.doc_id, line(decontaminate.words_of(r.text))) for r in docs.collect()]
    assert {(d, i) for d, text in texts for i, words in whole.items() if words in text} <= found


def test_fewer_dimensions_than_passages_lose_nothing(documents):
    """The latent space is smaller than the number of passages, leaves most pairs out, and what is near is what plain cosines say."""
    rng = random.Random(11)
    vocabulary = sorted({w for w in prose(2000, rng) if w not in COMMON})[:400]
    items = {i: [rng.choice(vocabulary) for _ in range(n)] for i, n in enumerate([20, 30, 48, 60, 100, 300] * 4)}
    texts = [[*prose(30, rng), *[w for w in words if rng.random() < keep], *prose(100, rng), *rng.choices(vocabulary, k=60)] for words in items.values() for keep in (0.3, 0.6, 1)]
    texts += [["zz", *items[0][:1] * 50], items[2][:3], []]
    docs = documents([(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])
    for rank in (decontaminate.RANK, 9):
        index = decontaminate.build_index(docs, items, rank)
        assert index.vectors.shape[1] < min(len(index.owners), rank + 1)
        compared, real = [], index._plain
        index._plain = lambda *given: compared.append((given[3].sum(), given[3].size)) or real(*given)
        passages = [(k, p) for k, words in items.items() for p in decontaminate.passages_of(words)]
        for words in texts:
            near, wanted = index.near(words), {}
            for start in range(0, len(words), decontaminate.WINDOW // 2):
                window = [w for w in words[start : start + decontaminate.WINDOW] if w in index.place]
                for key, passage in passages:
                    there = [w for w in passage if w in index.place]
                    a, b = Counter(window), Counter(there)
                    norm = math.sqrt(sum(index.squares[index.place[w]] for w in window) * sum(index.squares[index.place[w]] for w in there))
                    cosine = sum(n * b[w] * index.squares[index.place[w]] for w, n in a.items()) / norm if norm else 0
                    if cosine >= decontaminate.CANDIDATE_COSINE:
                        own = wanted.setdefault(key, {})
                        own[start] = max(own.get(start, 0), cosine)
            assert {(k, at) for k, v in near.items() for at in v} == {(k, at) for k, v in wanted.items() for at in v}
            assert all(near[k][at] == pytest.approx(c) for k, v in wanted.items() for at, c in v.items())
        if rank == decontaminate.RANK:
            assert sum(c for c, _ in compared) < sum(n for _, n in compared) / 2
