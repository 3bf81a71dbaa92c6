"""Labels by rule priority, repair of missed labels, label reports."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import Rule, contains, field_text, first_class, label_rules, repair_rules

NORMAL = "normal"


def rule_flag(name: str, rules: Sequence[Rule]) -> Column:
    """1 where the class ``name`` matches on its own, whatever else matches."""
    by_field: dict[str, list[str]] = {}
    for rule in rules:
        if rule.name == name:
            by_field.setdefault(rule.field, []).append(rule.pattern)
    hits = [contains(field_text(field), *patterns) for field, patterns in by_field.items()]
    return reduce(or_, hits, F.lit(False)).cast("int")


def label_requests(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Add ``attack_type`` (first matching class by priority, else normal) and ``is_attack``."""
    labeled = df.withColumn("attack_type", first_class(label_rules() if rules is None else rules, F.lit(NORMAL)))
    return labeled.withColumn("is_attack", (F.col("attack_type") != NORMAL).cast("int"))


def exclude_classes(df: DataFrame, *classes: str) -> DataFrame:
    return df.filter(~F.col("attack_type").isin(*classes))


def repair_labels(df: DataFrame, mode: str = "constant", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Relabel rows still normal that a repair rule matches.

    ``constant`` gives them one class of their own, ``typed`` the class of the first matching rule.
    """
    if mode not in ("constant", "typed"):
        raise ValueError(f"unknown repair mode {mode!r}")
    rules = repair_rules() if rules is None else list(rules)
    missed = (F.col("attack_type") == NORMAL) & (F.col("is_attack") == 0)
    if mode == "typed":
        found = first_class(rules, F.lit(None).cast("string"))
    else:
        found = first_class([r._replace(name=V.REPAIR_CONSTANT) for r in rules], F.lit(None).cast("string"))
    fixed = df.withColumn("_repair", F.when(missed, found))
    return (
        fixed.withColumn("attack_type", F.coalesce("_repair", "attack_type"))
        .withColumn("is_attack", F.when(F.col("_repair").isNotNull(), 1).otherwise(F.col("is_attack")))
        .drop("_repair")
    )


def repair_counts(df: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rows each repair rule fixes, a row counted for the first rule that matches it."""
    rules = repair_rules() if rules is None else list(rules)
    numbered = [Rule(str(i), r.field, r.pattern) for i, r in enumerate(rules)]
    missed = df.filter((F.col("attack_type") == NORMAL) & (F.col("is_attack") == 0))
    # Counted before the filter, so that the rule chain runs once per row.
    hits = missed.groupBy(first_class(numbered, F.lit(None).cast("string")).cast("int").alias("ord")).agg(F.count("*").alias("repaired"))
    named = F.element_at(F.array(*[F.lit(r.pattern) for r in rules]), F.col("ord") + 1)
    return (
        hits.filter(F.col("ord").isNotNull())
        .select("ord", named.alias("pattern"), "repaired")
    )
