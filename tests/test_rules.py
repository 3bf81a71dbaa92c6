import re

import pytest
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import Rule, alternation, label_rules, rules_from
from logsieve.operators import audit, coverage
from logsieve.operators.labeling import label_requests, repair_counts, repair_labels, rule_flag
from logsieve.sources.derived import PATHS

TEXTS = PATHS + [u for uris in V.PAYLOADS.values() for u in uris] + V.NEW_UA_RULES + ["", "/ENV", "/x/ENV", "//"]


@pytest.mark.parametrize(
    "patterns",
    [V.NEW_URI_RULES, V.OLD_URI_RULES, V.BODY_RULES, V.NEW_UA_RULES, [p for p, _ in V.REPAIR_RULES], V.BOT_WORDS]
    + [patterns for _, _, patterns in V.LABEL_RULES]
    + [[p for _, p in V.AUDIT_PATTERNS], [p for _, p in V.MISSED_PROBES]],
)
def test_shared_heads_match_like_single_patterns(patterns):
    joined = re.compile(alternation(patterns))
    for text in TEXTS:
        plain = any(re.search(p, text, re.IGNORECASE | re.ASCII) for p in patterns)
        assert bool(joined.search(text)) == plain, text


def sequential_label(path, referer, agent):
    """Overwrite in the documented order, lowest priority first."""
    rules = {}
    for rule in label_rules():
        rules.setdefault(rule.name, (rule.field, []))[1].append(rule.pattern)
    values = {"path": path or "", "user_agent": agent or "", "path_ref": f"{path or ''} {referer or ''}"}

    def hit(name):
        field, patterns = rules[name]
        return any(re.search(p, values[field], re.IGNORECASE | re.ASCII) for p in patterns)

    label = "normal"
    for name in ("automated_tool", "path_padding"):
        if hit(name) and label == "normal":
            label = name
    for name in ("sensitive_scan", "vuln_scan", "path_traversal", "sql_injection", "seo_spam"):
        if hit(name):
            label = name
    return label


def test_priority_equals_sequential_overwrite(requests):
    everything = "/?and/../../.env/admin?x=1=1&/example.com/example.com"
    cases = [(p, r, a) for p in [*TEXTS, None, everything] for r, a in (("-", "curl/8"), (None, None), ("/etc/passwd", "x"))]
    rows = [{"path": p, "referer": r, "user_agent": a} for p, r, a in cases]
    labels = label_requests(requests(*rows)).orderBy("row_id").select("attack_type", "is_attack").collect()
    assert [r.attack_type for r in labels] == [sequential_label(*c) for c in cases]
    assert all(r.is_attack == (r.attack_type != "normal") for r in labels)


def test_named_cases(requests):
    rows = [
        {"path": "/example.com/example.com/", "user_agent": "curl/8"},
        {"path": "/example.com/example.com/"},
        {"path": "/ok", "referer": "http://x/../../etc"},
        {"path": "/?and/../../.env", "user_agent": "curl/8"},
        {"path": "/.ENV"},
    ]
    got = [r.attack_type for r in label_requests(requests(*rows)).orderBy("row_id").collect()]
    assert got == ["automated_tool", "path_padding", "path_traversal", "seo_spam", "sensitive_scan"]


def test_repair_modes_and_counts(requests):
    paths = ["/?/x", "/nacos/a", "/abcdefgh.php", "//x", "/list?p=/a", "/plain", "/v1/cs/x", "/.env"]
    labeled = label_requests(requests(*[{"path": p} for p in paths]))
    typed = [r.attack_type for r in repair_labels(labeled, "typed").orderBy("row_id").collect()]
    assert typed == [
        "seo_spam_slash", "vuln_scan", "sensitive_scan", "vuln_scan", "path_traversal", "normal", "vuln_scan", "sensitive_scan",
    ]
    constant = [r.attack_type for r in repair_labels(labeled, "constant").orderBy("row_id").collect()]
    assert constant == ["mislabeled_fixed"] * 5 + ["normal", "mislabeled_fixed", "sensitive_scan"]
    assert {r.ord: r.repaired for r in repair_counts(labeled).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 7: 1}
    with pytest.raises(ValueError):
        repair_labels(labeled, "other")


def test_user_rules_from_a_table(spark, requests):
    table = spark.createDataFrame(
        [(2, "late", "path", "b"), (1, "early", "path", "a")], "ord int, name string, field string, pattern string"
    )
    rules = rules_from(table)
    assert rules == [Rule("early", "path", "a"), Rule("late", "path", "b")]
    got = label_requests(requests({"path": "/b"}, {"path": "/AB"}, {"path": "/c"}), rules).orderBy("row_id").collect()
    assert [r.attack_type for r in got] == ["late", "early", "normal"]


def brute_first_rule(uri, agent, method, body):
    for p in V.OLD_URI_RULES:
        if re.search(p, uri, re.I | re.A):
            return "uri_rule", p[:40]
    if re.search(V.SEO_SPAM_RULE, uri, re.I):
        return "seo_spam", V.SEO_SPAM_NAME
    for p, name in V.REPAIR_RULES:
        if re.search(p, uri, re.I | re.A):
            return "mislabel_rule", name
    for p in V.OLD_UA_RULES:
        if re.search(p, agent, re.I):
            return "ua_rule", p
    if method in V.BODY_METHODS and body:
        for p in V.BODY_RULES:
            if re.search(p, body, re.I | re.A):
                return "body_rule", p[:40]
    return None, None


def test_first_rule_with_body(requests):
    cases = [
        (text if text.startswith("/") else "/" + text, agent, method, body)
        for text in TEXTS
        for agent, method, body in (("zgrab", "GET", "eval (x"), ("m", "POST", "x onload = y"), ("m", "GET", "powershell"))
    ]
    df = requests(*[{"path": u, "user_agent": a, "method": m, "referer": b} for u, a, m, b in cases])
    rows = coverage.match_first_rule(df.withColumnRenamed("referer", "body"), "body").orderBy("row_id").collect()
    assert [(r.rule_type, r.matched) for r in rows] == [brute_first_rule(*c) for c in cases]


def test_slash_is_forced_and_errors_are_listed(requests):
    df = requests({"path": ".env"}, {"path": None}).withColumn("attack_type", F.lit("a")).withColumn("is_attack", F.lit(1))
    matched = coverage.match_old_new(df)
    assert [(r.uri, r.new_blocked) for r in matched.orderBy("row_id").collect()] == [("/.env", True), ("/", False)]
    assert [r.row_id for r in coverage.missed_listing(matched, "new_blocked", 5).collect()] == [1]


def test_audit_counts_rows_not_paths(requests):
    df = requests({"path": "/nacos/a"}, {"path": "/nacos/a"}, {"path": "/solr/nacos/"}, {"path": "/fine"}, {"path": "/.git"})
    labeled = label_requests(df)
    assert {r.pattern: r.hits for r in audit.audit_patterns(labeled).collect()} == {"nacos": 3, "solr": 1}
    samples = audit.audit_samples(labeled, n=2).filter("pattern = 'nacos'").orderBy("rank").collect()
    assert [(r.rank, r.row_id) for r in samples] == [(1, 0), (2, 1)]
    assert [(r.path, r.n) for r in audit.audit_matching(labeled, "nacos").collect()] == [("/nacos/a", 2), ("/solr/nacos/", 1)]


def test_a_class_may_search_several_fields(requests):
    rules = [Rule("a", "path", "zzz"), Rule("a", "user_agent", "curl"), Rule("b", "path", "yyy")]
    df = requests({"user_agent": "curl/8"}, {"path": "/zzz"}, {"path": "/yyy"})
    flags = df.orderBy("row_id").select(rule_flag("a", rules).alias("f"), rule_flag("none", rules).alias("g")).collect()
    assert [(r.f, r.g) for r in flags] == [(1, 0), (1, 0), (0, 0)]


def test_an_empty_rule_list_is_no_default(requests):
    df = requests({"path": "/?and/x"})
    assert label_requests(df, []).first().attack_type == "normal"
    labeled = label_requests(df, [])
    assert repair_labels(labeled, "typed", []).first().attack_type == "normal"


def test_fixture_reaches_every_pattern():
    from logsieve.sources.derived import PATHS, SITE_HOST, USER_AGENTS

    host = SITE_HOST.replace(".", r"\.")
    on_path = [p.replace("{host}", host) for _, field, patterns in V.LABEL_RULES if field != "user_agent" for p in patterns]
    on_path += [p for p, _ in V.REPAIR_RULES] + [p for _, p in [*V.AUDIT_PATTERNS, *V.MISSED_PROBES]]
    on_path += [*V.OLD_URI_RULES, *V.NEW_URI_RULES, *V.BODY_RULES, V.AUDIT_PHP, V.AUDIT_SUFFIX, V.SEO_SPAM_RULE]
    on_agent = [p for _, field, patterns in V.LABEL_RULES if field == "user_agent" for p in patterns] + [*V.OLD_UA_RULES, *V.NEW_UA_RULES]
    for pattern in on_path:
        assert any(re.search(pattern, path, re.I | re.A) for path in PATHS), pattern
    for pattern in on_agent:
        assert any(re.search(pattern, agent, re.I | re.A) for agent in USER_AGENTS), pattern
