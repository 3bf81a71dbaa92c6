import random
from collections import defaultdict

import pytest

from logsieve.llm import line_runs


def plain(rows, m):
    """{(doc_id, text): raw numbers of lines that go}, from all windows of m lines in order."""
    first, gone = {}, defaultdict(set)
    for doc_id, text in sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: (r[0], line_version(r[1]))):
        kept = [(raw, x.strip(" \t\n\x0b\f\r")) for raw, x in enumerate(text.split("\n"))]
        kept = [(raw, x) for raw, x in kept if x]
        for i in range(len(kept) - m + 1):
            window = tuple(x for _, x in kept[i : i + m])
            place = first.setdefault(window, (doc_id, text, i))
            if place[:2] != (doc_id, text) or i - place[2] >= m:
                gone[doc_id, text] |= {raw for raw, _ in kept[i : i + m]}
    return gone


def line_version(text):
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_equals_brute_force(documents, m):
    rng = random.Random(m)
    texts = ["\n".join(rng.choice(["a", "b", "c ", " d", "", "e e", "f"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4])]
    gone = plain(rows, m)
    found = line_runs.dedup_line_runs(documents([(*r, None, None) for r in rows]), m).collect()
    expected = []
    for d, t in rows:
        lines = t.split("\n")
        expected.append((d, sum(bool(x.strip()) for x in lines), len(gone[d, t]), "\n".join(x for i, x in enumerate(lines) if i not in gone[d, t])))
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in found) == sorted(expected)


def test_long_single_lines_go_too(documents):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["a", "b", "c d", "e f g", " h i j k ", "", "l m n"]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    gone, seen = plain(list(enumerate(texts)), 2), set()
    for d, t in enumerate(texts):
        for i, line in enumerate(x.strip() for x in t.split("\n")):
            if len(line.split()) >= 3:
                if line in seen:
                    gone[d, t].add(i)
                seen.add(line)
    found = line_runs.dedup_line_runs(documents([(*r, None, None) for r in enumerate(texts)]), 2, 3).collect()
    assert {r.doc_id: r.n_removed for r in found} == {d: len(gone[d, t]) for d, t in enumerate(texts)}
    many = "\n".join(["x", "y"] * 20_000)
    (row,) = line_runs.dedup_line_runs(documents([(1, many, None, None)])).collect()
    assert row.n_removed == 39_998 and row.text == "x\ny"


def test_ranks_follow_the_suffixes(documents):
    """Suffix array order: equal prefixes have equal ranks, and only repeated ones have any."""
    lines = line_runs.positions(documents([(1, "a\nb\nc\na\nb", None, None), (2, "a\nb\nd", None, None)]))
    ranks = line_runs.suffix_ranks(lines, 2).collect()
    assert {(r.doc_id, r.pos) for r in ranks} == {(1, 0), (1, 3), (2, 0)} and {r["rank"] for r in ranks} == {1}


def test_odd_rows(documents):
    rows = line_runs.dedup_line_runs(documents()).collect()
    assert len(rows) == 10 and sum(r.n_removed for r in rows) == 0
    assert [r.text for r in rows if r.doc_id == 2] == [""] and [r.n_lines for r in rows if r.doc_id == 3] == [0]
    assert line_runs.dedup_line_runs(documents([])).collect() == []


def test_plan_stays_in_the_engine(documents):
    plan = line_runs.dedup_line_runs(documents())._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
