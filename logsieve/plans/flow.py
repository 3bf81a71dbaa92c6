"""From log files to models and reports.

Each stage writes its table to shared storage and the next one reads it back, so that labels and features are
computed once and a lost executor costs one stage's tasks at most.
"""

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.requests import PROFILES
from logsieve.functions.rules import Rule
from logsieve.operators import learning, metrics
from logsieve.operators.features import feature_table, resolve_aliases
from logsieve.operators.labeling import exclude_classes, label_requests, repair_labels
from logsieve.operators.sampling import split_stratified, split_three
from logsieve.sources import artifacts
from logsieve.sources.logs import parse_log, read_log_lines
from logsieve.sources.tables import read_table, write_table


def prepare(spark: SparkSession, sites: dict[str, str], out: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Parse and label the logs of ``sites``, write ``parsed``, ``labeled`` and ``features`` under ``out``."""
    write_table(parse_log(read_log_lines(spark, sites)), f"{out}/parsed")
    prepare_requests(spark, read_table(spark, f"{out}/parsed"), out, rules)
    return read_table(spark, f"{out}/features")


def prepare_requests(spark: SparkSession, requests: DataFrame, out: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The same from a table of requests, whose path and agent columns may go by their other names."""
    write_table(label_requests(resolve_aliases(requests, ["path", "user_agent"]), rules), f"{out}/labeled")
    write_table(feature_table(read_table(spark, f"{out}/labeled")), f"{out}/features")
    return read_table(spark, f"{out}/features")


def _report(spark: SparkSession, report: DataFrame, path: str) -> None:
    artifacts.write_csv_report(report, path, files=1)


def train_binary(
    spark: SparkSession, out: str, profile: str = "v3", config: str = "regular", **override: Any
) -> learning.Trained:
    """Repair, split, train, save the model and write its reports. Bulk spam is left out."""
    cleaned = repair_labels(exclude_classes(read_table(spark, f"{out}/features"), "seo_spam"), "constant")
    write_table(split_three(cleaned), f"{out}/binary", ["split"])
    table = read_table(spark, f"{out}/binary")
    trained = learning.train_binary(table, PROFILES[profile], config, **override)
    artifacts.save_model(spark, trained, f"{out}/models/binary-{profile}")

    write_table(
        learning.score_binary(trained, table.filter(F.col("split") == "test")), f"{out}/scored-{profile}", ["attack_type"]
    )
    scored = read_table(spark, f"{out}/scored-{profile}")
    reports = f"{out}/reports/binary-{profile}"
    sweep = metrics.threshold_sweep(scored, V.SWEEP_GRIDS["fourteen"])
    _report(spark, learning.evaluate(scored), f"{reports}/metrics")
    _report(spark, sweep, f"{reports}/thresholds")
    _report(spark, metrics.best_threshold_fpr(sweep), f"{reports}/chosen_threshold")
    _report(spark, metrics.fnr_by_class(scored), f"{reports}/fnr_by_class")
    _report(spark, metrics.rule_priority(metrics.fnr_by_class(scored)), f"{reports}/rule_priority")
    _report(spark, learning.feature_importance(trained, table), f"{reports}/importance")
    return trained


def train_multiclass(spark: SparkSession, out: str, profile: str = "v3", **override: Any) -> learning.Trained:
    """The attack-class model: typed repair, stratified split, class map and per-class reports."""
    cleaned = repair_labels(exclude_classes(read_table(spark, f"{out}/features"), "seo_spam"), "typed")
    write_table(split_stratified(cleaned), f"{out}/multiclass", ["split"])
    table = read_table(spark, f"{out}/multiclass")
    trained = learning.train_multiclass(table, PROFILES[profile], **override)
    artifacts.save_model(spark, trained, f"{out}/models/multiclass")
    artifacts.write_json_document(
        spark, artifacts.class_map(learning.label_index(table)), f"{out}/models/multiclass/classes.json"
    )
    predicted = learning.score_multiclass(trained, table.filter(F.col("split") == "test"))
    pairs = metrics.pair_counts(predicted).cache()  # classes squared rows
    reports = f"{out}/reports/multiclass"
    _report(spark, metrics.class_report(pairs, 4), f"{reports}/classes")
    _report(spark, metrics.macro_metrics(pairs), f"{reports}/macro")
    _report(spark, metrics.normal_fpr(pairs), f"{reports}/normal_fpr")
    pairs.unpersist()
    return trained
