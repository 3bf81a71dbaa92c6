import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.operators import metrics
from logsieve.operators.distribution import auc, counts_below, distribution

# Published evaluation results: counts in, rates out.
BINARY_COUNTS = (343608, 11813, 1794, 13082)
BINARY_RATES = {"accuracy": 0.9633, "precision": 0.5255, "recall": 0.8794, "f1": 0.6579, "fpr": 0.0332, "fnr": 0.1206}
CLASSES = [
    "automated_tool", "normal", "path_padding", "path_traversal", "sensitive_scan", "seo_spam_slash", "sql_injection", "vuln_scan",
]
MATRIX = [
    [6915, 857, 0, 181, 44, 13, 9, 45],
    [5342, 341108, 1, 1182, 1011, 4472, 255, 1869],
    [0, 17, 0, 0, 0, 26, 0, 0],
    [1, 5, 0, 241, 16, 2, 0, 9],
    [6, 173, 0, 39, 1358, 125, 0, 287],
    [0, 131, 0, 0, 7, 2115, 0, 7],
    [1, 4, 0, 7, 0, 0, 4, 0],
    [19, 271, 0, 112, 241, 325, 1, 1443],
]
CLASS_F1 = [0.6797, 0.9777, 0.0, 0.2367, 0.5822, 0.453, 0.0281, 0.4753]


@pytest.fixture(scope="module")
def pairs(spark):
    cells = [(a, b, MATRIX[i][j]) for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)]
    return spark.createDataFrame(cells, "label string, pred string, n long").filter("n > 0")


def test_binary_golden(spark):
    counts = spark.createDataFrame([BINARY_COUNTS], "tn long, fp long, fn long, tp long")
    row = metrics.binary_metrics(counts).first()
    assert {m: row[m] for m in BINARY_RATES} == BINARY_RATES


def test_multiclass_golden(pairs):
    row = metrics.macro_metrics(pairs).first()
    assert (row.accuracy, row.macro_f1, row.weighted_f1) == (0.9538, 0.4291, 0.9619)
    assert (row.macro_precision, row.macro_recall) == (0.3638, 0.6456)
    assert round(metrics.normal_fpr(pairs).first().normal_fpr, 4) == 0.0398
    report = {r["class"]: r for r in metrics.class_report(pairs, 4).collect()}
    assert [report[c].f1 for c in CLASSES] == CLASS_F1
    assert report["normal"].support == 355240
    dense = {r.label: [r[c] for c in CLASSES] for r in metrics.confusion_matrix(pairs, CLASSES).collect()}
    assert [dense[c] for c in CLASSES] == MATRIX


def test_zero_denominators(spark):
    row = metrics.binary_metrics(spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.fpr, row.fnr) == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def scored(spark, scores, labels):
    rows = [(i, float(s), int(y), "a" if y else "normal") for i, (s, y) in enumerate(zip(scores, labels, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, score double, is_attack int, attack_type string")
    return df.withColumn("predicted", (F.col("score") >= 0.4).cast("int"))


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels, strict=True) if y]
    neg = [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_prefix_counts(spark):
    rng = random.Random(5)
    labels = [rng.random() < 0.3 for _ in range(1500)]
    scores = [0.5 if rng.random() < 0.35 else round(rng.random() * 0.8 + 0.2 * y, 5) for y in labels]
    df = scored(spark, scores, labels)
    assert auc(df).first().auc == pytest.approx(brute_auc(scores, labels), abs=1e-6)
    below = {r.score: (r.n, r.n_below) for r in counts_below(df, "score", {"n": F.count("*")}).collect()}
    assert all(below[s] == (scores.count(s), sum(x < s for x in scores)) for s in set(scores))


def test_auc_edges(spark):
    assert auc(scored(spark, [0.5] * 4, [0, 1, 0, 1])).first().auc == 0.5
    assert auc(scored(spark, [0.1, 0.2], [1, 1])).first().auc is None


def test_sweep_equals_recount(spark):
    rng = random.Random(6)
    labels = [rng.random() < 0.4 for _ in range(400)]
    scores = [rng.choice([0.3, 0.35, 0.4, 0.5, 0.85, rng.random()]) for _ in labels]
    rows = metrics.threshold_sweep(scored(spark, scores, labels), V.SWEEP_GRIDS["fourteen"]).collect()
    assert len(rows) == 14
    for r in rows:
        hits = [s >= r.threshold for s in scores]
        assert r.tp == sum(h and y for h, y in zip(hits, labels, strict=True))
        assert r.fp == sum(h and not y for h, y in zip(hits, labels, strict=True))
        assert r.tp + r.fn == sum(labels) and r.tp + r.fp + r.fn + r.tn == 400


def test_threshold_choice(spark):
    schema = "threshold double, fpr double, fnr double, f1 double"
    good = spark.createDataFrame([(0.3, 0.2, 0.0, 0.5), (0.5, 0.04, 0.3, 0.7), (0.6, 0.01, 0.3, 0.7)], schema)
    assert metrics.best_threshold_fpr(good).first().threshold == 0.5
    assert metrics.best_threshold_f1(good).first().threshold == 0.5
    none = spark.createDataFrame([(0.3, 0.2, 0.0, 0.5), (0.5, 0.1, 0.3, 0.6)], schema)
    row = metrics.best_threshold_fpr(none).first()
    assert (row.threshold, row.within_limit) == (0.5, 0)


def test_distribution_matches_numpy(spark):
    rng = random.Random(7)
    labels = [i % 3 == 0 for i in range(700)]
    scores = [round(rng.gauss(0.5, 0.1), 3) for _ in labels]
    for row in distribution(scored(spark, scores, labels), "score", "is_attack").collect():
        own = np.array([s for s, y in zip(scores, labels, strict=True) if y == bool(row.is_attack)])
        assert row.n == len(own)
        assert (row.mean, row.std) == (pytest.approx(own.mean(), abs=1e-6), pytest.approx(own.std(ddof=1), abs=1e-6))
        for q in (25, 50, 75, 90):
            assert row[f"p{q}"] == pytest.approx(np.quantile(own, q / 100), abs=1e-6)


def test_class_reports(spark):
    df = scored(spark, [0.1, 0.9, 0.9, 0.2], [1, 1, 0, 0])
    row = metrics.fnr_by_class(df).first()
    assert (row.total, row.tp, row.fn, row.fnr) == (2, 1, 1, 0.5)
    rates = {r.attack_type: r.rate for r in metrics.block_rate_by_class(df).collect()}
    assert rates == {"a": 0.5, "normal": 0.5}
    table = spark.createDataFrame([("x", 10, 0.2), ("y", 9, 0.9), ("z", 500, 0.06)], "attack_type string, total long, fnr double")
    got = {r.attack_type: (r.priority, r.rare) for r in metrics.rule_priority(table).collect()}
    assert got == {"x": ("high", 1), "y": ("low", 1), "z": ("medium", 0)}


def test_replay(spark):
    rows = [(403, "attack", "a", None), (200, "attack", "", None), (403, "normal", "normal", None), (0, "attack", "a", "timeout")]
    replay = spark.createDataFrame(rows, "status int, label string, attack_type string, error string")
    row = metrics.replay_metrics(replay).first()
    assert (row.errors, row.tp, row.fn, row.fp, row.tn) == (1, 1, 1, 1, 0)
    assert {r.attack_type: r.rate for r in metrics.replay_by_class(replay).collect()} == {"a": 100.0, "unknown": 0.0}


def test_importance_share_of_window_features(spark):
    rows = [("req_count_60s", 5493), ("ua_length", 4677), ("unique_url_60s", 4238), ("err_count_60s", 2437), ("rest", 11583)]
    table = metrics.importance_cumulative(spark.createDataFrame(rows, "feature string, importance long")).collect()
    shares = {r.feature: r.pct for r in table}
    assert round(sum(shares[f] for f in V.WINDOW_FEATURES), 1) == 42.8
    assert table[-1].cumulative_pct == 100.0


def test_scores_that_are_missing_reach_no_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, float("nan")), (0, 0.2)], "is_attack int, score double")
    rows = metrics.threshold_sweep(df, ["0.1", "0.5"]).orderBy("threshold").collect()
    assert [(r.tn, r.fp, r.fn, r.tp) for r in rows] == [(1, 1, 1, 1), (2, 0, 1, 1)]


def test_rows_without_a_prediction_or_status_are_counted(spark):
    df = spark.createDataFrame([(1, None), (0, None), (1, 1)], "is_attack int, predicted int")
    assert tuple(metrics.confusion(df).first()) == (1, 0, 1, 1)
    replay = spark.createDataFrame(
        [("attack", None, None), ("attack", 403, None), ("normal", None, "timeout")], "label string, status int, error string"
    )
    row = metrics.replay_metrics(replay).first()
    assert (row.errors, row.tn, row.fp, row.fn, row.tp, row.recall) == (1, 0, 0, 1, 1, 0.5)
