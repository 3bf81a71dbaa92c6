from hashlib import sha256

from logsieve.llm import exact_dedup


def test_odd_rows(documents):
    rows = exact_dedup.exact_groups(documents()).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    # empty group: ids 1, 2, 3 and a null; 3 has the most code points
    assert {by[i].keep_id for i in (1, 2, 3)} == {3} and by[3].kept and not by[1].kept and by[1].group_size == 4
    # 7 has one character more than 6
    assert by[6].keep_id == 7 and by[6].group_size == 3 and not by[6].kept and by[7].kept
    assert by[7].text_sha256 == sha256(b"thesamewordsstandheretwiceover").hexdigest()
    alone = [r for r in rows if r.doc_id is None and r.group_size == 1]
    assert len(alone) == 1 and alone[0].keep_id is None and alone[0].kept


def test_ties_go_to_the_smallest_id(documents):
    rows = exact_dedup.exact_groups(documents([(9, "a b", None, None), (3, "ab ", None, None), (5, "ab", None, None)])).collect()
    assert {r.keep_id for r in rows} == {3} and [r.doc_id for r in rows if r.kept] == [3]


def test_the_smallest_of_all_ids(documents):
    rows = exact_dedup.exact_groups(documents([(-(2**63), "a", None, None), (2**63 - 1, "a", None, None)])).collect()
    assert {r.keep_id for r in rows} == {-(2**63)}


def test_empty_table(documents):
    assert exact_dedup.exact_groups(documents([])).collect() == []


def test_colliding_hashes_are_told_apart(documents, monkeypatch):
    """With a hash of one value for all, the bytes decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "unhex", lambda c: F.lit(b"x"))
    rows = exact_dedup.exact_groups(documents([(1, "a", None, None), (2, "b", None, None), (3, "a ", None, None)])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_plan_stays_in_the_engine(documents):
    plan = exact_dedup.exact_groups(documents())._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
