"""Audits: what the labels and rules may have missed."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import contains, text
from logsieve.operators.labeling import NORMAL
from logsieve.operators.reports import top_per_group, top_values

Patterns = Sequence[tuple[str, str]]


def normal_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("attack_type") == NORMAL)


def _named_hits(uris: DataFrame, uri: str, patterns: Patterns) -> DataFrame:
    """Rows of a counted URI table once for each pattern they match."""
    names = F.array_compact(F.array(*[F.when(contains(F.col(uri), p), F.lit(name)) for name, p in patterns]))
    return uris.select("*", F.explode(names).alias("pattern"))


def audit_patterns(df: DataFrame, patterns: Patterns = V.AUDIT_PATTERNS) -> DataFrame:
    """Hits of each named pattern among normal rows; patterns without hits do not appear.

    Equal paths are counted first, so every distinct path is matched once however often it was requested.
    """
    paths = normal_rows(df).groupBy(text("path").alias("path")).agg(F.count("*").alias("n"))
    return _named_hits(paths, "path", patterns).groupBy("pattern").agg(F.sum("n").alias("hits"))


def audit_samples(df: DataFrame, patterns: Patterns = V.AUDIT_PATTERNS, n: int = 5) -> DataFrame:
    """First ``n`` paths of each pattern by row id."""
    path = text("path")
    names = F.array_compact(F.array(*[F.when(contains(path, p), F.lit(name)) for name, p in patterns]))
    # One alternation goes first: the single patterns are tried on paths that one of them matches.
    some = normal_rows(df).filter(contains(path, *[p for _, p in patterns]))
    hits = some.select("row_id", path.alias("path"), F.explode(names).alias("pattern"))
    best = top_per_group(hits, "pattern", [F.asc("row_id")], n)
    return best.select("pattern", "rank", "row_id", F.substring("path", 1, 150).alias("path"))


def audit_matching(df: DataFrame, pattern: str, top: int = 20) -> DataFrame:
    """Most frequent normal paths a pattern matches."""
    hits = normal_rows(df).filter(contains(text("path"), pattern))
    return top_values(hits, text("path"), "path", top)


def audit_residual(df: DataFrame) -> DataFrame:
    """Spam markers and empty user agents left among normal rows."""
    return normal_rows(df).agg(
        F.count("*").alias("normal_rows"),
        F.count_if(contains(text("path"), V.AND_TRAIN)).alias("and_pattern"),
        F.count_if(text("user_agent").isin("", "-")).alias("empty_ua"),
    )


def missed_probes(missed: DataFrame, patterns: Patterns = V.MISSED_PROBES, top: int = 3) -> DataFrame:
    """Per probe: uncaught attacks it matches, and the ``top`` classes among them. Distinct URIs are matched once."""
    uris = missed.groupBy("attack_type", "uri").agg(F.count("*").alias("n"))
    counts = _named_hits(uris, "uri", patterns).groupBy("pattern", "attack_type").agg(F.sum("n").alias("n"))
    by_probe = W.partitionBy("pattern")  # one row per class
    ranked = counts.withColumn("missed", F.sum("n").over(by_probe)).withColumn(
        "rank", F.row_number().over(by_probe.orderBy(F.desc("n"), F.asc("attack_type")))
    )
    return ranked.filter(F.col("rank") <= top).select(
        F.col("pattern").alias("probe"), "missed", "rank", "attack_type", "n"
    )
