import random
import re

import pytest
from pyspark.sql import functions as F

from logsieve.functions.rules import label_rules
from logsieve.operators.labeling import label_requests
from logsieve.operators.rule_tables import literals, match_rule_table
from logsieve.session import work_dir

RULES = "ord long, name string, field string, pattern string"


@pytest.mark.parametrize(
    ("pattern", "found"),
    [
        ("abc", ["abc"]), ("/Admin|login\\.php", ["/admin", "login.php"]), ("abc|x", None), ("ab?cde", ["cde"]), ("abcd*", ["abc"]),
        ("abcd+efg", ["abcd"]), ("(abcdef)?xyz", ["xyz"]), ("[abc]def{2}ghi", ["ghi"]), ("a.b.c", None), ("\\d+/wp-", ["/wp-"]),
        ("\\x41bcd", None), ("(?i)abcd", None), ("(?:x|y)\\.env", [".env"]), ("[^/\\]]abc", ["abc"]), ("a(b(c)[)]d)efg", ["efg"]),
        ("", None), ("école", ["cole"]), ("\\.\\./", ["../"]), ("abc{0,3}def", ["def"]), ("^/x/$", ["/x/"]), ("(?!abc)def", ["def"]),
    ],
)
def test_literals(pattern, found):
    assert literals(pattern) == found


def brute(rows, rules):
    compiled = [(o, f, re.compile("(?i)" + p, re.A)) for o, _, f, p in rules if p is not None]
    return {i: min((o for o, f, p in compiled if f in texts and p.search(texts[f])), default=None) for i, texts in rows.items()}


def test_equals_brute_force(spark, requests):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abC.") for _ in range(rng.randint(1, 5)))
    parts = ["{}", "{}?", "({}|{})", "[ab]{}", "{}+", "{}.*{}", "{}|{}", "^/{}", "{}$", "\\d{}"]
    rules = []
    for i in range(2_000):
        pattern = "".join(re.sub(r"\{\}", lambda m: re.escape(word()), rng.choice(parts)) for _ in range(rng.randint(1, 3)))
        rules.append((i * 3, f"r{i % 50}", rng.choice(["path", "user_agent", "path_ref", "other"]), pattern))
    rules += [(9_000, "none", "path", None), (-4, "rare", "user_agent", "zzzz"), (-5, "special", "path", "/only/here")]
    rng.shuffle(rules)
    rows = [{"path": "/" + "/".join(word() for _ in range(rng.randint(0, 5))), "user_agent": word() + word(), "referer": word()} for _ in range(300)]
    rows += [{"path": "/only/here"}, {"path": None, "user_agent": None, "referer": None}, {"path": "", "user_agent": "ZZzz"}, {"path": "/x" * 500}] + [rows[0]] * 50
    table = requests(*rows)
    given = {}
    for r in table.collect():
        path, agent, referer = (v or "" for v in (r.path, r.user_agent, r.referer))
        given[r.row_id] = {"path": path, "user_agent": agent, "path_ref": f"{path} {referer}"}
    # rules that match a few texts each, so that the first match is not always the same
    different = {i: t for i, t in given.items() if i <= 304}
    matched = {r: sum(v is not None for v in brute(different, [r]).values()) for r in rules}
    few = [r for r in rules if r[0] < 0 or r[3] is None or matched[r] <= 12]
    found = match_rule_table(table, spark.createDataFrame(few, RULES), work_dir(spark)).collect()
    expected = brute(given, few)
    assert {r.row_id: r.ord for r in found} == expected and len(found) == len(rows)
    names = {o: n for o, n, _, _ in few}
    assert all(r.name == names.get(r.ord) for r in found)
    assert len(few) > 500 and len(set(expected.values())) > 20 and None in expected.values()


def test_label_rules_as_a_table(spark, requests):
    rules = label_rules()
    table = spark.createDataFrame([(i, r.name, r.field, r.pattern) for i, r in enumerate(rules)], RULES)
    rows = requests({"path": "/.env"}, {"path": "/wp-login.php"}, {"path": "/a?id=1 union select 2"}, {"path": "/"}, {"user_agent": "sqlmap/1"}, {"path": "/../../etc/passwd"})
    found = {r.row_id: r.name or "normal" for r in match_rule_table(rows, table, work_dir(spark)).collect()}
    assert found == {r.row_id: r.attack_type for r in label_requests(rows).collect()}


def test_the_plan_does_not_grow_with_the_rules(spark, requests):
    def size(n):
        rules = spark.range(n).select(F.col("id").alias("ord"), F.lit("x").alias("name"), F.lit("path").alias("field"), F.concat(F.lit("/page"), "id", F.lit("/")).alias("pattern"))
        found = match_rule_table(requests(*[{"path": f"/page{i}/x"} for i in range(0, 30_000, 500)]), rules, work_dir(spark))
        assert found.where("ord is not null").count() == min(60, -(-n // 500))
        return len(re.sub(r"[0-9a-f-]{32,}|\d+", "", found._jdf.queryExecution().optimizedPlan().toString()))

    assert size(20_000) == size(20)


def test_empty_tables(spark, requests):
    none = spark.createDataFrame([], RULES)
    assert [r.ord for r in match_rule_table(requests({"path": "/x"}), none, work_dir(spark)).collect()] == [None]
    some = spark.createDataFrame([(1, "a", "path", "abc")], RULES)
    assert match_rule_table(requests({"path": "/x"}).limit(0), some, work_dir(spark)).collect() == []
