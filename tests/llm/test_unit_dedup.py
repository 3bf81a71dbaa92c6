import random

import pytest

from logsieve.llm import unit_dedup
from logsieve.llm.queries import QUERIES


def plain(rows, kind, min_words):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        found = [(a, e, form, form in seen or form in {f for _, _, f in list(unit_dedup.units_of(text, kind))[:i]}) for i, (a, e, form) in enumerate(unit_dedup.units_of(text, kind))]
        seen |= {f for _, _, f, _ in found}
        later = [(a, e, len(f.split()) >= min_words) for a, e, f, again in found if again]
        spans = []
        for i, (a, e, long) in enumerate(later):
            beside = (i > 0 and a - later[i - 1][1] <= 3 and later[i - 1][2]) or (i + 1 < len(later) and later[i + 1][0] - e <= 3 and later[i + 1][2])
            if long or beside:
                spans.append((a, e))
        out[doc_id] = (spans, unit_dedup.cut(text, spans))
    return out


@pytest.mark.parametrize("kind", ["sentence", "line", "paragraph"])
def test_equals_brute_force(documents, kind):
    rng = random.Random(8)
    sentences = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) + rng.choice(".!?") for n in (1, 2, 3, 5, 8) for _ in range(4)]
    rows = [(d, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 8)))) for d in range(50)]
    found = {r.doc_id: r for r in unit_dedup.dedup_units(documents([(*r, None, None) for r in rows]), kind, 3).collect()}
    for doc_id, (spans, text) in plain(rows, kind, 3).items():
        assert [(s["at"], s["end"]) for s in found[doc_id].removed] == spans
        assert found[doc_id].text == text and found[doc_id].n_removed == len(spans)


def test_a_passage_inside_other_text(documents):
    passage = "One long sentence of the passage that is here. A short one. Another long sentence that belongs to the same passage."
    rows = [(1, f"Begin here. {passage} The end."), (2, f"Quite another beginning! {passage} And another end.")]
    found = {r.doc_id: r.text for r in unit_dedup.dedup_units(documents([(*r, None, None) for r in rows])).collect()}
    assert found == {1: rows[0][1], 2: "Quite another beginning! And another end."}


def test_odd_rows(documents):
    rows = unit_dedup.dedup_units(documents(), min_words=3).collect()
    assert len(rows) == 10
    assert [r.text for r in rows if r.doc_id == 6] == ["the same words stand here twice over"] * 2
    assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    assert unit_dedup.dedup_units(documents([])).collect() == []
    clash = unit_dedup.dedup_units(documents([(1, "a b c d", None, None), (1, "x. a b c d", None, None)]), min_words=3).collect()
    assert sum(r.n_removed for r in clash) == 1


def test_stretches_of_short_units(spark, documents, tmp_path):
    """A repeated passage of short sentences goes whole, in scripts without spaces too; a short one by itself stays."""
    short, line = "He came in. She saw him. They sat down. Nobody spoke.", "我们今天早上在公园里看见了很多白色的鸟。它们都飞走了。"
    rows = [(1, f"First here. {short} The end."), (2, f"Other words! {short} Last."), (3, f"甲\n{line}"), (4, f"乙\n{line}"), (5, "Alone it is. He came in. And more.")]
    docs = documents([(*r, None, None) for r in rows])
    found = {r.doc_id: r.text for r in unit_dedup.dedup_units(docs, min_stretch=8).collect()}
    assert found == dict(rows) | {2: "Other words! Last.", 4: "乙\n"}


def test_production_setting_equals_brute_force(spark, documents, tmp_path):
    """Stretches of neighbouring later units that have 20 words together go, as the query sets it; everything else stays."""
    rng = random.Random(12)
    sentences = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 5, 9, 22]))).capitalize() + "." for _ in range(25)]
    rows = [(d, "".join(rng.choice(sentences) + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randint(0, 12)))) for d in range(60)]
    seen, want = set(), {}
    for doc_id, text in rows:
        spans, stretch = [], []

        def close():
            if sum(w for _, _, w in stretch) >= 20:
                spans.extend((a, e) for a, e, _ in stretch)
            stretch.clear()

        for a, e, form in unit_dedup.units_of(text, "sentence"):
            if form in seen:
                if stretch and a - stretch[-1][1] > 3:
                    close()
                stretch.append((a, e, len(form.split())))
            seen.add(form)
        close()
        want[doc_id] = unit_dedup.cut(text, spans)
    documents([(*r, None, None) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in QUERIES["op8_unit_dedup"](spark, str(tmp_path)).collect()} == want
