"""Rules as column expressions.

A rule list is plain data (``Rule`` rows); the builders below turn it into one expression, so that a whole rule
set is evaluated in the scan stage without a shuffle, a join or a Python worker.
"""

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V

class Rule(NamedTuple):
    name: str  # class or rule name the match yields
    field: str  # column the pattern is searched in
    pattern: str


def text(column: str) -> Column:
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def field_text(field: str) -> Column:
    """The searched text of a rule field; ``path_ref`` spans path and referer."""
    if field == "path_ref":
        return F.concat_ws(" ", text("path"), text("referer"))
    return text(field)


def slash_uri(path: Column) -> Column:
    """Request target with a leading slash forced."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _head(pattern: str) -> str | None:
    """First character of the pattern where it is a literal that every match starts with."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return None  # alternatives of its own
    found = re.match(r"(\\[^A-Za-z0-9]|[A-Za-z0-9/<])(?![?*+{])", pattern)
    return found.group(1) if found else None


def alternation(patterns: Iterable[str]) -> str:
    """One case-insensitive pattern that matches where any of ``patterns`` does.

    Patterns with the same first character share it, ``/(?:admin|backup)``, so that a position is given up after
    one comparison instead of one per pattern; over a long list this halves the matching time.
    """
    groups: dict[str, list[str]] = {}
    for pattern in patterns:
        head = _head(pattern) or ""
        groups.setdefault(head, []).append(f"(?:{pattern.removeprefix(head)})")
    return "(?i)" + "|".join(f"{head}(?:{'|'.join(tails)})" for head, tails in groups.items())


def contains(value: Column, *patterns: str) -> Column:
    return value.rlike(alternation(patterns))


def first_class(rules: Sequence[Rule], default: Column) -> Column:
    """Name of the first rule that matches. Adjacent rules with one name and field share one pattern."""
    merged: list[tuple[str, str, list[str]]] = []
    for rule in rules:
        if merged and merged[-1][:2] == (rule.name, rule.field):
            merged[-1][2].append(rule.pattern)
        else:
            merged.append((rule.name, rule.field, [rule.pattern]))
    branches = [F.when(contains(field_text(field), *patterns), F.lit(name)) for name, field, patterns in merged]
    return F.coalesce(*branches, default)


def label_rules(host: str = "example.com") -> list[Rule]:
    """The seven label classes, highest priority first, for the site ``host``."""
    quoted = host.replace(".", r"\.")
    return [
        Rule(name, field, pattern.replace("{host}", quoted))
        for name, field, patterns in V.LABEL_RULES
        for pattern in patterns
    ]


def repair_rules() -> list[Rule]:
    return [Rule(name, "path", pattern) for pattern, name in V.REPAIR_RULES]


def rules_from(df: DataFrame) -> list[Rule]:
    """Read a user's rule table ``(ord, name, field, pattern)`` in order. All of it becomes part of the query plan."""
    return [Rule(*row) for row in df.orderBy("ord").select("name", "field", "pattern").collect()]


def blacklisted(uri: Column, user_agent: Column, version: str = "new") -> Column:
    """Whether the new (URI + user agent) or old (URI + repair + user agent) blacklist blocks a request."""
    if version == "new":
        return contains(uri, *V.NEW_URI_RULES) | contains(user_agent, *V.NEW_UA_RULES)
    repair = [pattern for pattern, _ in V.REPAIR_RULES]
    return contains(uri, *V.OLD_URI_RULES, *repair) | contains(user_agent, *V.OLD_UA_RULES)


def first_rule(uri: Column, user_agent: Column, method: Column, body: Column | None = None) -> tuple[Column, Column]:
    """Position of the first blocking rule (NULL when none blocks), and the (rule_type, matched) of each position.

    Order: URI rules, spam, repair rules, user-agent rules, then the body of requests that carry one.
    """
    rules = [(uri, p, "uri_rule", p[:40]) for p in V.OLD_URI_RULES]
    rules.append((uri, V.SEO_SPAM_RULE, "seo_spam", V.SEO_SPAM_NAME))
    rules += [(uri, p, "mislabel_rule", name) for p, name in V.REPAIR_RULES]
    rules += [(user_agent, p, "ua_rule", p[:40]) for p in V.OLD_UA_RULES]
    if body is not None:
        carried = F.when(method.isin(V.BODY_METHODS), body)
        rules += [(carried, p, "body_rule", p[:40]) for p in V.BODY_RULES]
    return _first(rules)


def first_new_rule(uri: Column, user_agent: Column) -> tuple[Column, Column]:
    """The same for the new blacklist: URI rules, then user-agent rules."""
    rules = [(uri, p, "uri_rule", p[:40]) for p in V.NEW_URI_RULES]
    return _first([*rules, *[(user_agent, p, "ua_rule", p[:40]) for p in V.NEW_UA_RULES]])


def _first(rules: list[tuple[Column, str, str, str]]) -> tuple[Column, Column]:
    position = F.coalesce(*[F.when(contains(value, p), F.lit(i)) for i, (value, p, _, _) in enumerate(rules)])
    names = F.array(*[F.struct(F.lit(t).alias("rule_type"), F.lit(m).alias("matched")) for _, _, t, m in rules])
    return position, names
