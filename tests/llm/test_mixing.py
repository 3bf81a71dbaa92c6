from collections import Counter

from logsieve.llm import mixing


def filled(sizes, weights, share=1.5, most=2):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def corpus(n=600):
    return [(i, " ".join(["w"] * (i * 7 % 50)), None, [None, "a", "b", "c", "d"][min(4, i % 11)]) for i in range(n)]


def test_targets_and_words(documents):
    rows = corpus()
    found = mixing.mix(documents(rows), slots=1 << 12).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    goals = filled(sizes, mixing.WEIGHTS)
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in found:
        assert abs(r.target - goals[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 0.03 * goal
    again = mixing.mix(documents(rows[::-1]).repartition(5), slots=1 << 12).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_ranks_are_counted_per_source(spark):
    goals = spark.createDataFrame([("a", 10, 10.0), (None, 30, 30.0)], "source string, source_size long, target double")
    seen = {}
    for r in sorted(mixing.schedule(goals, 10_000).collect(), key=lambda r: r.slot):
        assert r.rank == seen.get(r.source, 0)
        seen[r.source] = r.rank + 1
    assert abs(seen["a"] - 2500) <= 5 and seen["a"] + seen[None] == 10_000


def test_odd_rows(documents):
    found = mixing.mix(documents(), slots=1 << 12).collect()
    assert len(found) == 10
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert mixing.mix(documents([])).collect() == []
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(documents([(1, None, None, "a"), (2, " ", None, None)])).collect())


def test_mixed_documents(documents):
    rows = corpus(200)
    docs = documents(rows)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert copies == Counter({d: int(t / s + 0.5) for d, (t, s) in taken.items() if s and int(t / s + 0.5)})


def test_small_sources_keep_their_share(documents):
    """More words make more slots and not longer blocks: a source far smaller than total / slots is met like the others."""
    rows = [(20 * d + s, " ".join(["w"] * 800), None, f"large{s}") for s in range(20) for d in range(20)]
    rows += [(1000 + 20 * s + d, " ".join(["w"] * 300), None, f"small{s}") for s in range(40) for d in range(10)]
    source = {i: s for i, _, _, s in rows}
    taken, goal = Counter(), {}
    for r in mixing.mix(documents(rows), slots=64).collect():
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert len(goal) == 60
    assert [s for s in goal if abs(taken[s] - goal[s]) > 0.1 * goal[s]] == []
