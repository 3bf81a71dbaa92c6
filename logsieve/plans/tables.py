"""The intermediate tables the queries share, from raw requests to scored ones."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.hashing import md5_number
from logsieve.functions.rules import blacklisted
from logsieve.operators.coverage import label_text, match_first_rule, match_old_new, with_uri
from logsieve.operators.features import feature_table
from logsieve.operators.labeling import exclude_classes, label_requests, repair_labels
from logsieve.sources import derived


def run_id() -> str:
    """Name part for tables a query writes, new for every run."""
    return uuid.uuid4().hex


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Evaluate costly columns where they are made, once per row.

    A filter on a label would otherwise be pushed below the projection that computes it, and run all its patterns
    a second time. Labels read from a stored table need none of this.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_once")).select(*rest, "_once.*")


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return once(label_requests(derived.access_log(spark, sf)), "attack_type", "is_attack")


def _cleaned(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return repair_labels(exclude_classes(labeled(spark, sf), "seo_spam"), mode)


def cleaned(spark: SparkSession, sf: str, mode: str = "constant") -> DataFrame:
    """Labelled requests without bulk spam, missed labels repaired."""
    return once(_cleaned(spark, sf, mode), "attack_type", "is_attack")


def features(spark: SparkSession, sf: str, profile: str = "train") -> DataFrame:
    return feature_table(label_requests(derived.access_log(spark, sf)), profile)


def cleaned_features(spark: SparkSession, sf: str, mode: str = "constant") -> DataFrame:
    """Features of the cleaned requests. Windows count all requests; bulk spam leaves the finished table."""
    return repair_labels(exclude_classes(features(spark, sf), "seo_spam"), mode)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return derived.scored(cleaned(spark, sf))


def scored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Scored requests with their features, as the false-positive reports need them."""
    return derived.scored(cleaned_features(spark, sf))


def first_rules(spark: SparkSession, sf: str) -> DataFrame:
    return once(match_first_rule(cleaned(spark, sf)), "blocked", "rule_type", "matched")


def typed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return derived.predicted_class(cleaned(spark, sf, "typed"))


def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    return once(match_old_new(cleaned(spark, sf)), "old_blocked", "new_blocked")


def replay(spark: SparkSession, sf: str) -> DataFrame:
    """Replay results: blocked requests answer 403, one request in forty times out."""
    sent = with_uri(cleaned(spark, sf))
    hit = blacklisted(F.col("uri"), F.col("ua"), "new")
    return sent.select(
        "row_id",
        F.when(hit, 403).otherwise(F.col("status")).alias("status"),
        "uri",
        "method",
        F.substring("ua", 1, 50).alias("ua"),
        label_text(F.col("is_attack")).alias("label"),
        "attack_type",
        F.when(md5_number("e", "row_id") % 40 == 0, "timeout").alias("error"),
    )
