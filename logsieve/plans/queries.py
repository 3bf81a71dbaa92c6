"""Named queries: one per operator, each over whole tables, as ``(spark, sf_dir) -> DataFrame``."""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.hashing import md5_number
from logsieve.functions.requests import (
    PROFILES,
    first_segment,
    path_features,
    request_features,
    scalar_features,
    ua_family,
    ua_features,
    uri_family,
    url_features,
)
from logsieve.functions.rules import label_rules, text
from logsieve.operators import audit, bans, boosting, coverage, distribution, labeling, learning, metrics, reports, sampling
from logsieve.operators.features import align_features, feature_table, select_profile
from logsieve.operators.joins import join_colocated, join_labels
from logsieve.operators.labeling import exclude_classes, repair_counts, repair_labels, rule_flag
from logsieve.operators.rule_tables import match_rule_table
from logsieve.operators.windows import add_previous_path, add_window_features
from logsieve.plans import tables
from logsieve.session import work_dir
from logsieve.sources import artifacts, derived, incremental, logs
from logsieve.sources import tables as stored_tables
from logsieve.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FP = "is_attack = 0 AND predicted = 1"
TN = "is_attack = 0 AND predicted = 0"
MC_CLASSES = [
    "automated_tool", "normal", "path_padding", "path_traversal", "sensitive_scan", "seo_spam_slash",
    "sql_injection", "vuln_scan",
]
REPORT_GRID = V.SWEEP_GRIDS["fourteen"]
#: The derived log holds a few requests per client and minute, so its limits are lower than the online ones.
SMALL_RATE_LIMIT = 8
SMALL_BAN_ERRORS = 4
SMALL_BAN_PERIOD = 300
SMALL_BAN = 120


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def named(name: str) -> Callable[[Query], Query]:
    """Register under a name that the operator itself already has in this module."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


# --- parsing --------------------------------------------------------------------


@query
def parse_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_log(derived.raw_log(spark, sf)).drop("event_time")


def _text_log(spark: SparkSession, sf: str, base: str) -> dict[str, str]:
    """The log as text files in row order, a folder for each site."""
    raw = derived.raw_log(spark, sf)
    for site in ("data", "www"):
        raw.filter(F.col("source") == site).orderBy("row_id").select("value").write.text(f"{base}/{site}")
    return {site: f"{base}/{site}" for site in ("data", "www")}


@query
def parse_text_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as text files, one folder per site, and read back: rows numbered by line over both sites."""
    sites = _text_log(spark, sf, f"{work_dir(spark)}/text-{tables.run_id()}")
    return logs.parse_log(logs.read_log_lines(spark, sites)).drop("event_time")


@query
def parse_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The log's two sites taken in one after the other: rows of the second run go on from those of the first."""
    base = f"{work_dir(spark)}/incremental-{tables.run_id()}"
    sites = _text_log(spark, sf, base)
    for some in (["data"], ["data", "www"]):
        incremental.update(spark, {site: sites[site] for site in some}, f"{base}/out")
    return stored_tables.read_table(spark, f"{base}/out/labeled").select("row_id", "source", "path", "status", "size", "attack_type")


@query
def parse_stats(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_stats(derived.raw_log(spark, sf))


@query
def table_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled table written partitioned by site and read back with pruned columns."""
    target = f"{work_dir(spark)}/labeled-{tables.run_id()}"
    stored_tables.write_table(tables.labeled(spark, sf), target)
    table = stored_tables.read_table(spark, target, ["source", "attack_type", "size"])
    return table.groupBy("source", "attack_type").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _report_round_trip(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """A report written with a header (CSV) or as objects (JSON) and read back with its schema."""
        target = f"{work_dir(spark)}/report-{tables.run_id()}"
        report = reports.value_counts(tables.labeled(spark, sf), "attack_type", "attack_type")
        schema = "attack_type string, n long, share double"
        if kind == "csv":
            artifacts.write_csv_report(report, target, files=1)
            return artifacts.read_csv_report(spark, target, schema)
        artifacts.write_json_report(report, target, files=1)
        return artifacts.read_json_report(spark, target, schema)

    return run


for _kind in ("csv", "json"):
    QUERIES[f"{_kind}_report_round_trip"] = _report_round_trip(_kind)


# --- projections and families ------------------------------------------------------


@query
def exclude_class(spark: SparkSession, sf: str) -> DataFrame:
    return exclude_classes(tables.labeled(spark, sf), "seo_spam").select("row_id", "attack_type", "is_attack")


def _profile(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return select_profile(tables.features(spark, sf), name)

    return run


for _name in PROFILES:
    QUERIES[f"feature_profile_{_name}"] = _profile(_name)


@named("align_features")
def align_feature_list(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar features aligned to the v3 list: the absent window features become 0, all values floats."""
    scalars = tables.labeled(spark, sf).select("row_id", *[c.alias(n) for n, c in scalar_features().items()])
    return align_features(scalars, PROFILES["v3"], keep=["row_id"])


@query
def top_first_segment(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_values(audit.normal_rows(tables.labeled(spark, sf)), first_segment(text("path")), "segment", 30)


@query
def uri_family_mix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(derived.access_log(spark, sf), uri_family(F.col("path")), "family")


@query
def ua_family_mix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(derived.access_log(spark, sf), ua_family(F.col("user_agent")), "family")


# --- rules --------------------------------------------------------------------------


def _label_flag(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return derived.access_log(spark, sf).select("row_id", rule_flag(name, label_rules()).alias("matched"))

    return run


for _class, _, _ in V.LABEL_RULES:
    QUERIES[f"label_{_class}"] = _label_flag(_class)


@query
def label_requests(spark: SparkSession, sf: str) -> DataFrame:
    return tables.labeled(spark, sf).select("row_id", "attack_type", "is_attack")


@query
def label_mix(spark: SparkSession, sf: str) -> DataFrame:
    return tables.labeled(spark, sf).groupBy("attack_type", "is_attack").agg(F.count("*").alias("n"))


@named("repair_labels")
def repair_labels_constant(spark: SparkSession, sf: str) -> DataFrame:
    return tables.cleaned(spark, sf).select("row_id", "attack_type", "is_attack")


@query
def repair_labels_typed(spark: SparkSession, sf: str) -> DataFrame:
    return repair_labels(tables.labeled(spark, sf), "typed").select("row_id", "attack_type", "is_attack")


@named("repair_counts")
def repair_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return repair_counts(tables.labeled(spark, sf))


@query
def audit_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_patterns(tables.labeled(spark, sf))


@query
def audit_samples(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_samples(tables.labeled(spark, sf))


@query
def audit_php(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_matching(tables.labeled(spark, sf), V.AUDIT_PHP)


@query
def audit_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_matching(tables.labeled(spark, sf), V.AUDIT_SUFFIX)


@query
def audit_residual(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_residual(tables.labeled(spark, sf))


@query
def rule_first_match(spark: SparkSession, sf: str) -> DataFrame:
    matched = tables.first_rules(spark, sf)
    return matched.select("row_id", F.col("blocked").cast("int").alias("blocked"), "rule_type", "matched")


@query
def rule_first_match_body(spark: SparkSession, sf: str) -> DataFrame:
    """First match with request bodies; the referer stands in for a body."""
    matched = coverage.match_first_rule(
        tables.labeled(spark, sf).withColumn("body", F.concat_ws(" ", "path", "referer")), "body"
    )
    return matched.groupBy("method", "rule_type", "matched").agg(F.count("*").alias("n"))


@query
def rule_table_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label rules as a table, joined by their rarest literals."""
    rules = spark.createDataFrame(
        [(i, *rule) for i, rule in enumerate(label_rules())], "ord long, name string, field string, pattern string"
    )
    found = match_rule_table(derived.access_log(spark, sf), rules, work_dir(spark))
    return found.select("row_id", F.coalesce("name", F.lit("normal")).alias("attack_type"))


@query
def rule_table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every path of the pages, tried on all pages: the smallest page id with the same path, whatever its case."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("row_id"), F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1).alias("path")
    )
    quoted = F.regexp_replace("path", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")
    rules = pages.groupBy("path").agg(F.min("row_id").alias("ord")).select(
        "ord", F.concat(F.lit("page "), F.col("ord").cast("string")).alias("name"), F.lit("path").alias("field"),
        F.concat(F.lit("^"), quoted, F.lit("$")).alias("pattern"),
    )
    requests = pages.select("row_id", "path", F.lit("").alias("user_agent"), F.lit("").alias("referer"))
    return match_rule_table(requests, rules, work_dir(spark), ["path"])


@named("rule_match_oldnew")
def rule_match_old_new(spark: SparkSession, sf: str) -> DataFrame:
    return tables.rule_matches(spark, sf).select(
        "row_id", F.col("old_blocked").cast("int").alias("old_blocked"), F.col("new_blocked").cast("int").alias("new_blocked")
    )


@named("missed_probe")
def missed_probes(spark: SparkSession, sf: str) -> DataFrame:
    matched = tables.first_rules(spark, sf)
    return audit.missed_probes(matched.filter((F.col("is_attack") == 1) & ~F.col("blocked")))


@named("missed_probe_all")
def missed_probes_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same probes over all attacks, caught or not."""
    return audit.missed_probes(coverage.with_uri(tables.labeled(spark, sf)).filter(F.col("is_attack") == 1))


@query
def payload_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.corpus_coverage(derived.rule_corpus(spark, sf))


@query
def payload_missed(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.corpus_missed(derived.rule_corpus(spark, sf))


@query
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.rule_coverage(tables.first_rules(spark, sf))


@query
def rule_compare(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.rule_compare(tables.rule_matches(spark, sf))


@query
def rule_missed(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missed_by_class(tables.rule_matches(spark, sf))


@query
def rule_missed_listing(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.missed_listing(tables.rule_matches(spark, sf), "new_blocked", 20)


@query
def rule_false_block_listing(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.false_block_listing(tables.rule_matches(spark, sf), "old")


@query
def rule_false_block_listing_new(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.false_block_listing(tables.rule_matches(spark, sf), "new")


# --- features --------------------------------------------------------------------------


@query
def features_url(spark: SparkSession, sf: str) -> DataFrame:
    return derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in url_features().items()])


@query
def features_url_serve(spark: SparkSession, sf: str) -> DataFrame:
    return derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in url_features("serve").items()])


@query
def features_ua(spark: SparkSession, sf: str) -> DataFrame:
    return derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in ua_features().items()])


@query
def features_request(spark: SparkSession, sf: str) -> DataFrame:
    return derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in request_features().items()])


@query
def features_path(spark: SparkSession, sf: str) -> DataFrame:
    return derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in path_features().items()])


@named("feature_table")
def feature_table_all(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf)


@query
def feature_table_serve(spark: SparkSession, sf: str) -> DataFrame:
    return tables.features(spark, sf, "serve")


@query
def lag_same_url(spark: SparkSession, sf: str) -> DataFrame:
    return add_previous_path(derived.access_log(spark, sf)).select("row_id", "prev_path", "same_url")


def _window(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return add_window_features(derived.access_log(spark, sf)).select("row_id", "ip", "event_s", name)

    return run


for _key, _name in zip(("win_req_count", "win_err_count", "win_unique_url"), V.WINDOW_FEATURES, strict=True):
    QUERIES[_key] = _window(_name)


def _importance_stand_in(spark: SparkSession, sf: str) -> DataFrame:
    """A number per feature without a model: attacks in which the feature is above zero."""
    table = tables.features(spark, sf)
    counts = table.agg(
        *[F.count_if((F.col("is_attack") == 1) & (F.col(f) > 0)).alias(f) for f in PROFILES["v3"]]
    )
    return reports.to_rows(counts, [{"feature": F.lit(f), "importance": F.col(f)} for f in PROFILES["v3"]])


@query
def importance_cum(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.importance_cumulative(_importance_stand_in(spark, sf))


@query
def samples_per_class(spark: SparkSession, sf: str) -> DataFrame:
    best = reports.top_per_group(tables.labeled(spark, sf), "attack_type", [F.asc("row_id")], 5)
    return best.select("attack_type", "rank", "row_id", F.substring(text("path"), 1, 150).alias("path"))


@query
def top_fn_per_class(spark: SparkSession, sf: str) -> DataFrame:
    missed = tables.scored(spark, sf).filter((F.col("is_attack") == 1) & (F.col("predicted") == 0))
    best = reports.top_per_group(missed, "attack_type", [F.desc("score"), F.asc("row_id")], 10)
    return best.select("attack_type", "rank", "row_id", "score", F.substring(text("path"), 1, 100).alias("path"))


# --- samples and splits ------------------------------------------------------------------


@query
def sample_n(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_n(derived.access_log(spark, sf), 1000).select("row_id", "ip", "path")


@query
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(tables.cleaned(spark, sf), 500, 500).select("row_id", "attack_type", "label")


@query
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_random(tables.cleaned(spark, sf)).select("row_id", "is_attack", "split")


@query
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_stratified(tables.cleaned(spark, sf, "typed")).select("row_id", "attack_type", "split")


@query
def fp_sample(spark: SparkSession, sf: str) -> DataFrame:
    wrong = tables.scored(spark, sf).filter(FP)
    return wrong.orderBy("row_id").limit(1000).select("row_id", "path", "attack_type", "source", "ip", "is_attack", "score")


# --- joins ---------------------------------------------------------------------------------


@named("join_labels")
def join_label_columns(spark: SparkSession, sf: str) -> DataFrame:
    features = derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in path_features().items()])
    return join_labels(features, tables.labeled(spark, sf))


@query
def join_labels_colocated(spark: SparkSession, sf: str) -> DataFrame:
    """The same from tables in buckets by row id."""
    base, buckets = f"{work_dir(spark)}/bucketed-{tables.run_id()}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    features = derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in path_features().items()])
    labels = tables.labeled(spark, sf).select("row_id", "is_attack", "attack_type")
    return join_colocated(
        stored_tables.write_bucketed(features, f"{base}/features", buckets), stored_tables.write_bucketed(labels, f"{base}/labels", buckets)
    )


@named("join_labels_left")
def join_label_columns_left(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the lines that parse; requests whose line does not keep NULL labels."""
    features = derived.access_log(spark, sf).select("row_id", *[c.alias(n) for n, c in ua_features().items()])
    parsed = labeling.label_requests(logs.parse_log(derived.raw_log(spark, sf)))
    return join_labels(features, parsed, "left").drop("is_attack")


def _bans(spark: SparkSession, sf: str) -> DataFrame:
    return bans.ban_windows(derived.access_log(spark, sf), SMALL_BAN_ERRORS, SMALL_BAN_PERIOD, SMALL_BAN)


@query
def ban_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _bans(spark, sf)


@query
def ban_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    marked = bans.mark_banned(derived.access_log(spark, sf), _bans(spark, sf))
    return marked.select("row_id", "ip", "event_s", "banned")


@query
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return bans.rate_limited(derived.access_log(spark, sf), SMALL_RATE_LIMIT)


@query
def layered_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and bans come before the labels, so that only narrow rows are shuffled and each rule runs once."""
    marked = bans.mark_banned(add_window_features(derived.access_log(spark, sf)), _bans(spark, sf))
    return coverage.layered_verdict(derived.scored(tables.once(labeling.label_requests(marked), "attack_type", "is_attack")), SMALL_RATE_LIMIT).select("row_id", "attack_type", "verdict")


# --- reports ---------------------------------------------------------------------------------


@query
def mix_status_normal(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent status codes of requests that no rule labels."""
    normal = tables.labeled(spark, sf).filter(F.col("is_attack") == 0)
    return reports.value_counts(normal, "status", "status", top=20)


def _missed_at(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    return tables.scored(spark, sf).filter((F.col("is_attack") == 1) & (F.col("score") < threshold))


@query
def missed_mix_high(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of the attacks that a threshold of 0.85 misses."""
    return reports.value_counts(_missed_at(spark, sf, 0.85), "attack_type", "attack_type")


@query
def missed_paths_high(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the first 30 of them."""
    first = _missed_at(spark, sf, 0.85).orderBy("row_id").limit(30)
    return first.select("row_id", F.substring(text("path"), 1, 120).alias("path"))


@query
def mix_status(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(derived.access_log(spark, sf), "status", "status")


@query
def mix_method(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(derived.access_log(spark, sf), "method", "method", top=10)


@query
def mix_source(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(derived.access_log(spark, sf), "source", "source")


@query
def mix_class(spark: SparkSession, sf: str) -> DataFrame:
    return reports.value_counts(tables.labeled(spark, sf), "attack_type", "attack_type")


@query
def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_balance(tables.cleaned(spark, sf))


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(tables.scored(spark, sf))


@query
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.binary_metrics(metrics.confusion(tables.scored(spark, sf)), 6)


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_report(metrics.pair_counts(tables.typed_predictions(spark, sf)))


@query
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return distribution.auc(tables.scored(spark, sf))


def _sweep(grid: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return metrics.threshold_sweep(tables.scored(spark, sf), V.SWEEP_GRIDS[grid])

    return run


QUERIES["threshold_sweep"] = _sweep("fourteen")
for _grid in ("half_up", "eight", "ten", "offline", "full", "complete", "search"):
    QUERIES[f"threshold_sweep_{_grid}"] = _sweep(_grid)


@query
def best_threshold_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_threshold_fpr(metrics.threshold_sweep(tables.scored(spark, sf), REPORT_GRID))


@query
def best_threshold_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_threshold_f1(metrics.threshold_sweep(tables.scored(spark, sf), V.SWEEP_GRIDS["search"]))


@query
def fnr_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fnr_by_class(tables.scored(spark, sf))


@query
def block_rate_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.block_rate_by_class(tables.scored(spark, sf))


@query
def fn_detail(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fn_detail(tables.scored(spark, sf))


@query
def rule_priority(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rule_priority(metrics.fnr_by_class(tables.scored(spark, sf)))


@query
def fp_tn_means(spark: SparkSession, sf: str) -> DataFrame:
    means = reports.group_means(
        tables.scored_features(spark, sf), V.FP_COMPARE_FEATURES, FP, TN, ("fp_mean", "tn_mean")
    )
    return means.select(
        "feature",
        F.round("fp_mean", 6).alias("fp_mean"),
        F.round("tn_mean", 6).alias("tn_mean"),
        F.round(F.col("fp_mean") - F.col("tn_mean"), 6).alias("difference"),
    )


@query
def class_means(spark: SparkSession, sf: str) -> DataFrame:
    means = reports.group_means(
        tables.features(spark, sf), PROFILES["v3"], "is_attack = 0", "is_attack = 1", ("normal_mean", "attack_mean")
    )
    floor = F.greatest(F.abs("normal_mean"), F.lit(0.001))
    return means.select(
        "feature",
        F.round("normal_mean", 6).alias("normal_mean"),
        F.round("attack_mean", 6).alias("attack_mean"),
        F.round(F.col("attack_mean") / floor, 6).alias("ratio"),
    )


@query
def stat_feature_health(spark: SparkSession, sf: str) -> DataFrame:
    """Window features: mean and share above zero per label, and their share of all importance."""
    table = tables.features(spark, sf)
    attack = F.col("is_attack") == 1
    wide = table.agg(
        *[F.avg(F.when(~attack, F.col(f))).alias(f"nm_{f}") for f in V.WINDOW_FEATURES],
        *[F.avg(F.when(attack, F.col(f))).alias(f"am_{f}") for f in V.WINDOW_FEATURES],
        *[F.avg(F.when(~attack, (F.col(f) > 0).cast("double"))).alias(f"nz_{f}") for f in V.WINDOW_FEATURES],
        *[F.avg(F.when(attack, (F.col(f) > 0).cast("double"))).alias(f"az_{f}") for f in V.WINDOW_FEATURES],
        *[F.count_if(attack & (F.col(f) > 0)).alias(f"im_{f}") for f in PROFILES["v3"]],
    )
    total = sum((F.col(f"im_{f}") for f in PROFILES["v3"]), F.lit(0))
    return reports.to_rows(
        wide,
        [
            {
                "feature": F.lit(f),
                "normal_mean": F.round(F.col(f"nm_{f}"), 6),
                "attack_mean": F.round(F.col(f"am_{f}"), 6),
                "normal_nonzero": F.round(F.col(f"nz_{f}"), 6),
                "attack_nonzero": F.round(F.col(f"az_{f}"), 6),
                "importance_pct": F.round(reports.ratio(F.col(f"im_{f}") * 100, total), 6),
            }
            for f in V.WINDOW_FEATURES
        ],
    )


@query
def train_serve_skew(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of every v3 feature as trained and as served, over the same requests in one scan."""
    served = {**scalar_features("serve"), **{f: F.lit(0) for f in V.WINDOW_FEATURES}}
    names = PROFILES["v3"]
    both = feature_table(
        labeling.label_requests(derived.access_log(spark, sf)), "train", extra={f"serve_{n}": served[n] for n in names}, keep=[]
    )
    wide = both.agg(
        *[F.avg(n).alias(f"t_{n}") for n in names], *[F.avg(f"serve_{n}").alias(f"s_{n}") for n in names]
    )
    return reports.to_rows(
        wide,
        [
            {
                "feature": F.lit(n),
                "train_mean": F.round(F.col(f"t_{n}"), 6),
                "serve_mean": F.round(F.col(f"s_{n}"), 6),
                "skew": F.round(F.col(f"t_{n}") - F.col(f"s_{n}"), 6),
            }
            for n in names
        ],
    )


@query
def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return distribution.distribution(tables.scored(spark, sf), "score", "is_attack")


@query
def ua_length_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lengths = tables.labeled(spark, sf).select("is_attack", F.length(text("user_agent")).alias("ua_length"))
    return distribution.distribution(lengths, "ua_length", "is_attack")


@query
def short_ua_share(spark: SparkSession, sf: str) -> DataFrame:
    lengths = tables.labeled(spark, sf).select("is_attack", F.length(text("user_agent")).alias("ua_length"))
    return distribution.short_share(lengths, "ua_length", "is_attack", 10)


@query
def fp_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    wrong = tables.scored(spark, sf).filter(FP)
    return reports.breakdown(
        wrong,
        {
            "attack_type": F.col("attack_type"),
            "source": F.col("source"),
            "method": F.col("method"),
            "uri_family": uri_family(F.col("path")),
            "ua_family": ua_family(F.col("user_agent")),
        },
    )


@query
def replay_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.replay_metrics(tables.replay(spark, sf))


@query
def replay_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.replay_by_class(tables.replay(spark, sf))


@query
def confusion_mc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.pair_counts(tables.typed_predictions(spark, sf)), MC_CLASSES)


@query
def normal_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.normal_fpr(metrics.pair_counts(tables.typed_predictions(spark, sf)))


@query
def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_metrics(metrics.pair_counts(tables.typed_predictions(spark, sf)))


@query
def metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_delta(tables.scored(spark, sf))


# --- learning -----------------------------------------------------------------------------------


@query
def class_weight_binary(spark: SparkSession, sf: str) -> DataFrame:
    return learning.binary_weight(tables.cleaned(spark, sf))


@query
def class_weight_multi(spark: SparkSession, sf: str) -> DataFrame:
    return learning.multiclass_weights(tables.cleaned(spark, sf, "typed"))


@query
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    return learning.label_index(tables.cleaned(spark, sf, "typed"))


def _binary_table(spark: SparkSession, sf: str) -> DataFrame:
    """Feature table with its split, written once: training reads it many times and must survive lost executors."""
    table = sampling.split_three(tables.cleaned_features(spark, sf))
    return stored_tables.stored(table, work_dir(spark))


def _share(*names: str) -> Column:
    """Whether all of these columns lie between 0 and 1."""
    return reduce(and_, [F.col(n).between(0, 1) for n in names]).cast("int")


def _binary_report(config: str, profiles: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Per feature profile: rows of the three parts, and the test rows' classes as the model's counts add them up."""
        table = _binary_table(spark, sf)
        sizes = {f"{r['split']}_rows": r["count"] for r in table.groupBy("split").count().collect()}
        rows = []
        for profile in profiles:
            trained = learning.train_binary(table, PROFILES[profile], config)
            report = learning.evaluate(learning.score_binary(trained, table.filter(F.col("split") == "test")))
            sums = report.select(
                F.lit(profile).alias("profile"),
                (F.col("tp") + F.col("fn")).alias("positives"),
                (F.col("fp") + F.col("tn")).alias("negatives"),
                _share(*metrics.RATES, "auc").alias("rates_ok"),
            )
            rows.append(sums.withColumns({name: F.lit(n).cast("long") for name, n in sorted(sizes.items())}))
        return reduce(DataFrame.unionByName, rows)

    return run


QUERIES["train_binary"] = _binary_report("regular", ("v3", "v4"))
for _config in ("base", "weighted"):
    QUERIES[f"train_binary_{_config}"] = _binary_report(_config, ("v3",))


def _multiclass_report(learner: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Support of every class in the stratified test part, with the model's measures in range."""
        split = sampling.split_stratified(tables.cleaned_features(spark, sf, "typed"))
        table = stored_tables.stored(split, work_dir(spark))
        trained = learning.train_multiclass(table, PROFILES["v3"], learner)
        predicted = learning.score_multiclass(trained, table.filter(F.col("split") == "test"))
        report = metrics.class_report(metrics.pair_counts(predicted))
        return report.filter("support > 0").select("class", "support", _share("precision", "recall", "f1").alias("rates_ok"))

    return run


QUERIES["train_multiclass"] = _multiclass_report("forest")


#: Of the stratified training part, one row in eight decides when boosting ends.
VALID_PARTS = 8
#: A round takes several jobs whatever its data, so the queries take larger steps than the library's defaults.
BOOSTED_STEP, BOOSTED_PATIENCE = 0.3, 10


@query
def train_patience(spark: SparkSession, sf: str) -> DataFrame:
    """Boosting that waits: rows of the parts, how it ended, and the test rows' classes.

    ``waited``: it ended by patience or at the last round. ``lowest``: the model ends at the lowest validation loss.
    """
    table = _binary_table(spark, sf)
    found = boosting.boost_binary(table, PROFILES["v3"], "base", BOOSTED_PATIENCE, stepSize=BOOSTED_STEP)
    limit = learning.BINARY_CONFIGS["base"]["maxIter"]
    kept, seen = F.sum("kept"), F.count("*")
    ending = found.rounds.agg(
        ((seen == kept + BOOSTED_PATIENCE) | (seen == limit)).cast("int").alias("waited"),
        (F.min("valid_loss") == F.max_by("valid_loss", F.col("kept") * F.col("round"))).cast("int").alias("lowest"),
    )
    report = learning.evaluate(learning.score_binary(found.trained, table.filter(F.col("split") == "test")))
    sizes = table.groupBy().pivot("split", ["train", "valid", "test"]).count()
    sums = report.select(
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("fp") + F.col("tn")).alias("negatives"),
        _share(*metrics.RATES, "auc").alias("rates_ok"),
    )
    parts = sizes.select(*[F.col(n).alias(f"{n}_rows") for n in ("train", "valid", "test")])
    return sums.join(ending).join(parts)  # one row each


@query
def train_multiclass_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Per class of the test part: its rows, those whose chances add up to 1, and the measures in range."""
    split = sampling.split_stratified(tables.cleaned_features(spark, sf, "typed"))
    held = (F.col("split") == "train") & (md5_number("valid", "row_id") % VALID_PARTS == 0)
    table = stored_tables.stored(split.withColumn("split", F.when(held, "valid").otherwise(F.col("split"))), work_dir(spark))
    found = boosting.boost_multiclass(table, PROFILES["v3"], patience=BOOSTED_PATIENCE, stepSize=BOOSTED_STEP)
    predicted = boosting.class_chances(found.trained, table.filter(F.col("split") == "test"))
    total = F.aggregate("chances", F.lit(0.0), lambda a, b: a + b)
    summed = predicted.groupBy(F.col("attack_type").alias("class")).agg(F.count_if(F.abs(total - 1) < 1e-9).alias("summed"))
    report = metrics.class_report(metrics.pair_counts(predicted)).filter("support > 0")
    report = report.select("class", "support", _share("precision", "recall", "f1").alias("rates_ok"))
    return report.join(summed, "class")


@query
def config_search(spark: SparkSession, sf: str) -> DataFrame:
    """Per configuration: the test rows' classes, and whether its threshold is one of the grid's."""
    ranked, _ = learning.search(_binary_table(spark, sf), PROFILES["v4"])
    grid = [float(t) for t in V.SWEEP_GRIDS["search"]]
    return ranked.select(
        "config",
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("fp") + F.col("tn")).alias("negatives"),
        F.col("best_threshold").isin(grid).cast("int").alias("in_grid"),
        _share(*metrics.RATES, "auc", "best_f1").alias("rates_ok"),
    )


@named("score")
def score_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Model saved, loaded again and applied to every request with served features."""
    table = _binary_table(spark, sf)
    path = f"{work_dir(spark)}/model-{tables.run_id()}"
    artifacts.save_model(spark, learning.train_binary(table, PROFILES["v4"]), path)
    loaded = artifacts.load_model(spark, path)
    served = align_features(tables.features(spark, sf, "serve"), loaded.features)
    scored = learning.score_binary(loaded, served)
    decided = F.col("predicted") == (F.col("score") >= V.DEFAULT_THRESHOLD).cast("int")
    return scored.select("row_id", "attack_type", _share("score").alias("score_ok"), decided.cast("int").alias("decision_ok"))


@named("feature_importance")
def model_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of the model, with the sum of all shares."""
    table = _binary_table(spark, sf)
    trained = learning.train_binary(table, PROFILES["v3"])
    shares = metrics.importance_cumulative(learning.feature_importance(trained, table))
    total = F.round(F.sum("pct").over(W.partitionBy()), 3)  # one row per feature
    return shares.select("feature", total.alias("total_pct"))


@query
def importance_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of a saved model, and whether all split counts add up to one less than the leaves per tree."""
    table = _binary_table(spark, sf)
    path = f"{work_dir(spark)}/model-{tables.run_id()}"
    artifacts.save_model(spark, learning.train_binary(table, PROFILES["v3"]), path)
    nodes = artifacts.node_table(spark, path)
    counted = learning.importance_splits(nodes, PROFILES["v3"])
    trees = nodes.agg((F.count_if(F.col("feature").isNull()) - F.count_if(F.col("depth") == 0)).alias("inner"))
    every = F.sum("splits").over(W.partitionBy())  # one row per feature
    counted = counted.select("feature", every.alias("total"), (F.col("splits") >= 0).alias("counted"))
    return counted.join(trees).select("feature", ((F.col("total") == F.col("inner")) & F.col("counted")).cast("int").alias("counts_ok"))


# --- streaming -------------------------------------------------------------------------------------


@query
def stream_label(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines parsed and labelled by a stream that drains what is there, then stops."""
    base = f"{work_dir(spark)}/stream-{tables.run_id()}"
    sites = _text_log(spark, sf, f"{base}/lines")
    jobs.run_label_stream(spark, sites, f"{base}/labeled", f"{base}/state", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/labeled").groupBy("source", "attack_type").agg(F.count("*").alias("n"))


def _replay(spark: SparkSession, sf: str, base: str, job: Callable[[DataFrame], None], slices: int = 4) -> None:
    """The whole log as a stream of requests: time slices arrive one after the other, ``job`` drains each as a micro-batch.

    A slice has as many files as it has tasks. The job goes on from its checkpoint.
    """
    requests = stored_tables.stored(derived.access_log(spark, sf).select(*jobs.REQUEST_COLUMNS), work_dir(spark))
    marks = [i / slices for i in range(1, slices)]
    cuts = requests.agg(F.percentile_approx("event_s", marks)).first()[0] or []
    slot = sum(((F.col("event_s") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    schema = "row_id long, ip string, event_s long, path string, status int"
    for k in range(len(cuts) + 1):
        requests.filter(F.coalesce(slot, F.lit(0)) == k).write.mode("append").parquet(f"{base}/requests")
        job(spark.readStream.schema(schema).parquet(f"{base}/requests"))


@query
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes above the limit, those still open when the log ends included."""
    base = f"{work_dir(spark)}/stream-{tables.run_id()}"

    def job(requests: DataFrame) -> None:
        timed = requests.withColumn("event_time", F.timestamp_seconds("event_s"))
        jobs.run_rate_limit(timed, f"{base}/limits", f"{base}/checkpoint", SMALL_RATE_LIMIT)

    _replay(spark, sf, base, job)
    return jobs.rate_limits(spark, f"{base}/limits")


@query
def stream_bans(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{work_dir(spark)}/stream-{tables.run_id()}"

    def job(requests: DataFrame) -> None:
        jobs.run_ban_stream(
            requests, f"{base}/bans", f"{base}/state", f"{base}/checkpoint", SMALL_BAN_ERRORS, SMALL_BAN_PERIOD, SMALL_BAN
        )

    _replay(spark, sf, base, job)
    # A ban that later batches extend is stored again; the last end holds.
    return spark.read.parquet(f"{base}/bans").groupBy("ip", "ban_start").agg(F.max("ban_end").alias("ban_end"))


@query
def stream_live_features(spark: SparkSession, sf: str) -> DataFrame:
    """Window features of the whole log, fed to a stream."""
    base = f"{work_dir(spark)}/stream-{tables.run_id()}"
    _replay(spark, sf, base, lambda requests: jobs.run_live_features(
        requests, f"{base}/features", f"{base}/state", f"{base}/checkpoint"
    ))
    return spark.read.parquet(f"{base}/features").select("row_id", *V.WINDOW_FEATURES)
