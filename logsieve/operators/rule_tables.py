"""First matching rule from a rule table of any size.

A rule list becomes part of the query plan (``functions/rules.py``), which suits hundreds of rules. A rule table stays a table: every
pattern is filed under the rarest gram of a literal that all its matches contain, the grams of the distinct texts are
joined with them, and a pattern is tried only on the texts that hold its gram. Patterns without such a literal are tried on every
distinct text, as one expression.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.rules import Rule, field_text
from logsieve.sources.tables import stored

#: Characters of a gram. Literals that are shorter file no rule; a longer one uses the longest of LENGTHS that it has, as few texts share that.
GRAM = 3
LENGTHS = (12, 6, GRAM)
FIELDS = ("path", "user_agent", "path_ref")

_BREAKS = set("dDwWsSbBAzZnrtfGR")  # escapes that stand for other characters than themselves


def _skip(pattern: str, at: int) -> int:
    """Place after the group or character class that begins at ``at``."""
    depth, in_class = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            in_class += 1
        elif c == "]":
            in_class = max(in_class - 1, 0)
        elif not in_class:
            depth += (c == "(") - (c == ")")
        at += 1
        if not depth and not in_class:
            break
    return at


def literals(pattern: str) -> list[str] | None:
    """For each top-level alternative the longest ASCII literal, in lower case, that every match of it contains.

    None where an alternative has none of GRAM characters, or the pattern uses syntax that is not looked into.
    """
    if "[]" in pattern or "[^]" in pattern or "\\Q" in pattern:
        return None
    found, runs, run, at = [], [], "", 0
    while at <= len(pattern):
        c = pattern[at : at + 1]
        quantified = None
        if c in ("", "|"):
            longest = max([*runs, run], key=len)
            if len(longest) < GRAM:
                return None
            found.append(longest.lower())
            runs, run, at = [], "", at + 1
            continue
        if c in "([":
            if pattern.startswith("(?", at) and pattern[at + 2 : at + 3] not in (":", "=", "!", "<", ">"):
                return None  # flags may change what a character means
            at = _skip(pattern, at)
        elif c == "\\":
            quantified = pattern[at + 1 : at + 2]
            if quantified.isalnum():
                if quantified not in _BREAKS:
                    return None
                quantified = None
            at += 2
        else:
            quantified = c if c not in ".^$?*+{})]" else None
            at = pattern.find("}", at) + 1 or len(pattern) if c == "{" else at + 1
        after = pattern[at : at + 1]
        if not quantified or not quantified.isascii() or after and after in "?*{":
            runs, run = [*runs, run], ""
        else:
            run += quantified
            if after == "+":
                runs, run = [*runs, run], ""
    return found


def _filed(patterns: pd.Series) -> pd.Series:
    return pd.Series([literals(p) for p in patterns], dtype=object)


def _grams(value: str, n: int) -> F.Column:
    places = F.sequence(F.lit(1), F.length(value) - (n - 1))
    cut = F.transform(places, lambda i: F.substring(F.col(value), i, F.lit(n)))
    return F.when(F.length(value) >= n, F.array_distinct(cut))


def _all_grams(value: str) -> F.Column:
    return F.concat(*[F.coalesce(_grams(value, n), F.array().cast("array<string>")) for n in LENGTHS])


def first_rules(texts: DataFrame, rules: DataFrame, folder: str) -> DataFrame:
    """(field, text, ord) of the first rule, by ``ord``, that matches a text; texts that none matches are left out.

    ``texts`` has distinct (field, text), ``rules`` (ord, name, field, pattern). Case is ignored for ASCII letters. Intermediate tables lie
    under ``folder``. A gram that many texts hold is split over tasks; a rule whose grams are all in no text is never tried.
    """
    filed = rules.where("pattern is not null").select("ord", "field", "pattern", F.pandas_udf(_filed, "array<string>")("pattern").alias("literals"))
    filed = stored(filed, folder)
    texts = texts.select("field", "text", F.lower("text").alias("low"), F.xxhash64("text").alias("id"))
    grams = F.explode(_all_grams("low")).alias("gram")

    branches = filed.where("literals is not null").select("ord", "field", "pattern", F.posexplode("literals").alias("branch", "literal"))
    ours = branches.select("*", F.explode(F.coalesce(*[_grams("literal", n) for n in LENGTHS])).alias("gram"))
    # how many texts hold a gram: counted inside the map tasks, there are few different ones
    held = texts.select("field", grams).groupBy("field", "gram").agg(F.count("*").alias("n"))
    counted = ours.join(held, ["field", "gram"], "left")
    # a branch with a gram that no text holds matches nowhere
    rarest = counted.groupBy("ord", "field", "pattern", "branch", "literal").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    )
    index = stored(rarest.where("n > 0").select("field", "gram", "ord", "pattern", "literal"), folder)
    # grams travel with a hash of their text; texts of one hash are told apart by the search itself
    near = texts.select("field", "id", grams).join(index, ["field", "gram"]).select("field", "id", "ord", "pattern", "literal").distinct()
    tried = texts.join(near, ["field", "id"]).where(F.contains("low", "literal"))
    hits = tried.where(F.rlike("text", F.concat(F.lit("(?i)"), F.col("pattern")))).select("field", "text", "ord")

    rest = [Rule(*r) for r in filed.where("literals is null").orderBy("ord").select(F.col("ord").cast("string"), "field", "pattern").collect()]
    for field in sorted({r.field for r in rest}):
        tests = [F.when(F.col("text").rlike("(?i)" + r.pattern), F.lit(int(r.name))) for r in rest if r.field == field]
        chain = texts.where(F.col("field") == field).select("field", "text", F.coalesce(*tests).cast("long").alias("ord"))
        hits = hits.unionByName(chain.where("ord is not null"))
    return hits.groupBy("field", "text").agg(F.min("ord").alias("ord"))


def match_rule_table(requests: DataFrame, rules: DataFrame, folder: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(row_id, ord, name): the first rule of the table that matches each request, NULL where none does.

    ``rules`` holds (ord, name, field, pattern), ``ord`` unique whole numbers; a rule with a field that is not in ``fields``, or without
    a pattern, matches nothing. Each distinct text is searched once, however many requests have it.
    """
    ordered = rules.select(F.col("ord").cast("long").alias("ord"), "name", "field", "pattern")
    named = F.array(*[F.struct(F.lit(f).alias("field"), field_text(f).alias("text")) for f in fields])
    every = requests.select("row_id", F.explode(named).alias("_f")).select("row_id", "_f.*")
    found = stored(first_rules(stored(every.select("field", "text").distinct(), folder), ordered, folder), folder)
    # the hash makes both sides move, so that a text of many requests is split over tasks
    spread = F.xxhash64("text")
    hit = every.withColumn("spread", spread).join(found.withColumn("spread", spread), ["field", "text", "spread"])
    first = hit.groupBy("row_id").agg(F.min("ord").alias("ord")).join(ordered.select("ord", "name"), "ord")
    return requests.select("row_id").join(first, "row_id", "left").select("row_id", "ord", "name")
