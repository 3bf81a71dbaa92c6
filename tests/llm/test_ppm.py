import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.llm import ppm


def plain_model(texts):
    seen = defaultdict(Counter)
    for text in texts:
        data = b"\n" + b" ".join(ppm.words_of(text)) + b"\n"
        for i in range(1, len(data)):
            for j in range(min(ppm.ORDER, i) + 1):
                seen[data[i - j : i]][data[i]] += 1
    return seen


def plain_score(text, seen):
    """Method D with symbol exclusion, a symbol at a time."""
    data, total = b"\n" + b" ".join(ppm.words_of(text)) + b"\n", 0.0
    for i in range(1, len(data)):
        excluded = set()
        for j in range(min(ppm.ORDER, i), -1, -1):
            counts = seen.get(data[i - j : i])
            if counts is None:
                continue
            left = {s: n for s, n in counts.items() if s not in excluded}
            mass = 2 * sum(left.values())
            if data[i] in left:
                total += math.log10((2 * left[data[i]] - 1) / mass)
                break
            if left:
                total += math.log10(len(left) / mass)
            excluded |= counts.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


TEXTS = {
    1: "the cat sat on the mat", 2: "The dog sat\ton the log", 3: "", 4: None, 5: "zebra crossing \x00 ñandú", 6: "the", 7: "the cat sat on the mat", 8: "unseen words  entirely",
}


@pytest.mark.parametrize("heads", [(1 << 20, 1 << 20), (3, 2), (0, 0)])
def test_equals_a_plain_coder(documents, heads):
    docs = documents([(d, t, None, None) for d, t in TEXTS.items()])
    found = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id").isin(5, 8), head_grams=heads[0], head_words=heads[1]).collect()}
    learned = [t for d, t in TEXTS.items() if d not in (5, 8)]
    seen, tokens = plain_model(learned), Counter()
    for t in learned:
        tokens.update([*ppm.words_of(t), "end"])
    n, v = sum(tokens.values()), len(tokens)
    for d, text in TEXTS.items():
        own = [*ppm.words_of(text), "end"]
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(t in tokens for t in own), n, d in (5, 8))
        assert r.base_score == pytest.approx(sum(math.log10((tokens[t] + 1) / (n + v + 1)) for t in own))
        assert r.score == pytest.approx(plain_score(text, seen))


def test_odd_rows(documents):
    rows = ppm.score(documents(), ppm.held_out()).collect()
    assert len(rows) == 10 and sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert ppm.score(documents([]), ppm.held_out()).collect() == []
    nothing = ppm.score(documents([(1, "ab", None, None)]), F.lit(True)).collect()
    assert nothing[0].score == pytest.approx(3 * math.log10(1 / 256)) and nothing[0].n_known == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5_000])
def test_places(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    found = ppm.Places(keys)
    asked = np.concatenate([keys[::-1], rng.integers(0, 1 << 62, 100), np.zeros(1, np.int64)])
    where = {k: i for i, k in enumerate(keys.tolist())}
    assert found.find(asked).tolist() == [where.get(k, -1) for k in asked.tolist()]
