import random
import re

import pytest

from logsieve.llm import license_rules as given
from logsieve.llm import licenses

CASES = [
    ("Released under the MIT License.", "mit", "mit"),
    ("licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "apache-2", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3", "", "gpl-3"),
    ("the GNU General Public License as published; GNU General Public License version 2 or any later version", "", "gpl,gpl-2-or-later"),
    ("SPDX-License-Identifier: BSD-3-Clause", "", "bsd-3"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc", "cc-by-nc"),
    ("shared under cc by-nc-sa", "cc-by-nc", "cc-by-nc,cc-by-nc-sa"),
    ("see https://creativecommons.org/licenses/by/4.0/ for it", "", "cc-by-4.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "", "mit"),
    ("under\nthe\tMIT -- license, under the mit license", "mit", "mit"),
    ("sub mit licensed permit license", "", ""),
    ("all rights reserved", "", "all-rights-reserved"),
]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = "".join(f" {w} " for w in words)
    hits = []
    for i, rule in enumerate(given.RULES):
        for m in re.finditer(rule.pattern, joined):
            first = joined[: m.start()].count(" ") // 2
            hits.append((first, first + len(m[0].split()) - 1, rule.level, i, rule))
    stay = [a for a in hits if not any(b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[2:4] < a[2:4]) for b in hits)]
    base = [h for h in hits if h[4].base]
    kept = stay + base
    joined_labels = lambda rows: ",".join(sorted({h[4].label for h in rows}))
    starts = [h[0] for h in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), joined_labels(base), joined_labels(kept),
        max((given.CONFIDENCE[h[2]] for h in kept), default=0.0),
    )


def found(documents, texts):
    rows = licenses.scan(documents([(i, t, None, None) for i, t in enumerate(texts)])).collect()
    return {r.doc_id: tuple(r)[1:] for r in rows}


def test_known_cases(documents):
    rows = found(documents, [c[0] for c in CASES])
    assert [(rows[i][4], rows[i][5]) for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert [rows[i] for i in range(len(CASES))] == [plain(c[0]) for c in CASES]


def test_like_trying_every_rule(documents):
    """Texts of pieces of names, so that detections touch, overlap and contain each other."""
    rng = random.Random(3)
    pieces = [c[0] for c in CASES] + ["version 3", "or any later version", "the", "license", "GNU", "lesser", "by-nc", "cc", "under the", "MIT", "2.0", "filler words", "Apache", "ä ö"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(120)]
    rows = found(documents, texts)
    for i, text in enumerate(texts):
        assert rows[i] == plain(text), text


def some_text(pattern, rng):
    """A text that the pattern matches: alternatives and optional parts by chance."""
    form = re.sub(r"\[(.)[^\]]*\](\{\d+,\d+\})?", lambda m: m[1] * (4 if m[2] else 1), re.sub(r"\.\{\d+,\d+\}\??", " x ", pattern))
    pick = lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))
    while "(" in form:
        form = re.sub(r"\((?:\?:)?([^()]*)\)(\?)?", pick, form)
    return re.sub(r"(\S)\?", lambda m: rng.choice(["", m[1]]), form)


def test_every_match_holds_the_keyword_and_a_gate():
    rng = random.Random(5)
    for rule in given.RULES:
        assert any(g.replace(" ", "  ") in rule.keyword for g in given.GATES), rule
        for _ in range(60):
            text = some_text(rule.pattern, rng)
            assert re.search(rule.pattern, text) and rule.keyword in text, (rule, text)
    assert len({(r.level, r.pattern, r.label) for r in given.RULES}) == len(given.RULES) > 300


def test_odd_rows(documents):
    rows = licenses.scan(documents()).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].labels == "" and by[1].first_word is None and by[1].score == 0.0
    assert by[4].n_words == 18_000 and sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    many = "under the mit license " * 20_000
    (row,) = licenses.scan(documents([(1, many, None, None)])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (80_000, 20_000, 0, 79_996)
    assert licenses.scan(documents([])).collect() == []


def test_plan_stays_in_the_engine(documents):
    plan = licenses.scan(documents())._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    from logsieve.llm.oracle import ORACLE
    from logsieve.llm.queries import QUERIES

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    frame = QUERIES["op11_licenses"](spark, "/root/testdata/sf0.001")
    twin = con.sql(ORACLE["op11_licenses"])
    assert twin.columns == frame.columns
    assert sorted(map(str, twin.fetchall())) == sorted(str(tuple(r)) for r in frame.collect())
