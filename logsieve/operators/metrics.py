"""Evaluation reports over scored requests (``is_attack``, ``attack_type``, ``score``, ``predicted``)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.operators.distribution import auc
from logsieve.operators.reports import ratio, to_rows

COUNTS = ["tn", "fp", "fn", "tp"]
RATES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]


def confusion(df: DataFrame, label: str = "is_attack", predicted: str = "predicted") -> DataFrame:
    """The four counts; a row without a prediction counts as predicted normal."""
    y, p = F.col(label), F.coalesce(F.col(predicted), F.lit(0))
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def rate_columns(digits: int = 4) -> dict[str, Column]:
    """The six rates from the four counts; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    rates = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }
    return {name: F.round(rate, digits) for name, rate in rates.items()}


def binary_metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Counts and rates from a table of counts."""
    rates = rate_columns(digits)
    return counts.select("*", *[rates[name].alias(name) for name in RATES])


def threshold_sweep(df: DataFrame, grid: Sequence[str], digits: int = 6) -> DataFrame:
    """Metrics at every threshold (``score >= threshold``) from one pass over the scores.

    A row's slot is the number of thresholds it reaches; counting rows per slot and summing slots from the top
    gives the counts of every threshold. ``grid`` is ascending decimal text. A NULL or NaN score reaches none.
    """
    marks = sorted(float(t) for t in grid)
    if len(marks) != len(set(marks)):
        raise ValueError("thresholds repeat")
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    slot = sum(((score >= F.lit(m)).cast("int") for m in marks), F.lit(0))
    y = F.col("is_attack")
    slots = df.groupBy(slot.alias("slot")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(m).alias("threshold")) for i, m in enumerate(marks)]
    # From here on there are at most len(grid) + 1 rows.
    reached = slots.select("pos", "neg", "slot", F.explode(F.array(*steps)).alias("s"))
    above = F.col("slot") >= F.col("s.step")
    counts = reached.groupBy(F.col("s.threshold").alias("threshold")).agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
    )
    return binary_metrics(counts, digits)


def best_threshold_fpr(sweep: DataFrame, limit: float = V.FPR_LIMIT) -> DataFrame:
    """Lowest FNR among thresholds under the FPR limit, else the lowest FPR; the lower threshold wins ties."""
    allowed = F.col("fpr") < limit
    return (
        sweep.withColumn("within_limit", allowed.cast("int"))
        .orderBy(F.desc("within_limit"), F.when(allowed, F.col("fnr")).otherwise(F.col("fpr")), "threshold")
        .limit(1)
    )


def best_threshold_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def fnr_by_class(df: DataFrame) -> DataFrame:
    """Miss rate of each attack class."""
    attacks = df.filter(F.col("is_attack") == 1)
    missed = F.count_if(F.col("predicted") == 0)
    return attacks.groupBy("attack_type").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("predicted") == 1).alias("tp"),
        missed.alias("fn"),
        F.round(ratio(missed, F.count("*")), 6).alias("fnr"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


def fn_detail(df: DataFrame) -> DataFrame:
    """Missed attacks per class: count, mean and highest score."""
    missed = df.filter((F.col("is_attack") == 1) & (F.col("predicted") == 0))
    return missed.groupBy("attack_type").agg(
        F.count("*").alias("fn"),
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.round(F.max("score"), 6).alias("max_score"),
    )


def rule_priority(by_class: DataFrame) -> DataFrame:
    """How urgently a class needs rules of its own."""
    enough = F.col("total") >= 10
    priority = (
        F.when((F.col("fnr") > 0.15) & enough, "high").when((F.col("fnr") > 0.05) & enough, "medium").otherwise("low")
    )
    return by_class.select(
        "attack_type", "total", "fnr", priority.alias("priority"), (F.col("total") < 100).cast("int").alias("rare")
    )


def block_rate_by_class(df: DataFrame) -> DataFrame:
    """Blocked share of each attack class; for a class without attacks its false-positive share."""
    counts = df.groupBy(F.coalesce("attack_type", F.lit("normal")).alias("attack_type")).agg(
        F.count_if(F.col("is_attack") == 1).alias("attacks"),
        F.count_if((F.col("is_attack") == 1) & (F.col("predicted") == 1)).alias("blocked"),
        F.count_if(F.col("is_attack") == 0).alias("normals"),
        F.count_if((F.col("is_attack") == 0) & (F.col("predicted") == 1)).alias("false_blocks"),
    )
    rate = F.when(F.col("attacks") > 0, ratio(F.col("blocked"), F.col("attacks"))).otherwise(
        ratio(F.col("false_blocks"), F.col("normals"))
    )
    return counts.withColumn("rate", F.round(rate, 6))


def pair_counts(df: DataFrame, label: str = "attack_type", predicted: str = "predicted_type") -> DataFrame:
    """(label, prediction) counts: classes squared rows, from which all multiclass reports follow."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def _class_rates(pairs: DataFrame) -> DataFrame:
    side = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted")),
            F.struct(F.col("pred").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted")),
        )
    )
    right = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = pairs.select(right.alias("right"), side.alias("s")).groupBy(F.col("s.class").alias("class")).agg(
        F.sum("s.support").alias("support"),
        F.sum("s.predicted").alias("predicted"),
        # every right pair is seen from both sides
        F.sum(F.when(F.col("s.support") > 0, F.col("right")).otherwise(0)).alias("right"),
    )
    return sides.select(
        "class",
        ratio(F.col("right"), F.col("predicted")).alias("precision"),
        ratio(F.col("right"), F.col("support")).alias("recall"),
        ratio(2 * F.col("right"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def class_report(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    rounded = [F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")]
    return _class_rates(pairs).select("class", *rounded, "support")


def macro_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1 over the classes that occur."""
    weight = F.col("support").cast("double")
    total = F.sum("support").cast("double")
    kinds = ("precision", "recall", "f1")
    return _class_rates(pairs).agg(
        F.round(F.sum(F.col("recall") * weight) / total, 4).alias("accuracy"),
        *[F.round(F.avg(m), 4).alias(f"macro_{m}") for m in kinds],
        *[F.round(F.sum(F.col(m) * weight) / total, 4).alias(f"weighted_{m}") for m in kinds],
    )


def normal_fpr(pairs: DataFrame, normal: str = "normal") -> DataFrame:
    """Share of normal rows predicted as any attack."""
    rows = pairs.filter(F.col("label") == normal)
    wrong = F.coalesce(F.sum(F.when(F.col("pred") != normal, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return rows.agg(
        total.alias("normal_total"), wrong.alias("misclassified"), F.round(ratio(wrong, total), 6).alias("normal_fpr")
    )


def confusion_matrix(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Dense matrix in the given class order: one row per label, one column per prediction."""
    return pairs.groupBy("label").pivot("pred", list(classes)).agg(F.sum("n")).na.fill(0)


def replay_metrics(replay: DataFrame) -> DataFrame:
    """Recall, miss and false-block rates of a replay; rows with an error are left out and counted. A request without a
    status was not blocked."""
    ok = F.col("error").isNull()
    attack, blocked = F.col("label").eqNullSafe("attack"), F.col("status").eqNullSafe(403)
    counts = replay.agg(
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & ~attack & ~blocked).alias("tn"),
        F.count_if(ok & ~attack & blocked).alias("fp"),
        F.count_if(ok & attack & ~blocked).alias("fn"),
        F.count_if(ok & attack & blocked).alias("tp"),
    )
    rates = rate_columns(6)
    return counts.select("*", *[rates[r].alias(r) for r in ("recall", "fnr", "fpr", "precision")])


def replay_by_class(replay: DataFrame) -> DataFrame:
    """Block rate per attack class of a replay; an empty class counts as unknown."""
    ok = replay.filter(F.col("error").isNull() & (F.col("label") == "attack"))
    name = F.when(F.coalesce("attack_type", F.lit("")) == "", "unknown").otherwise(F.col("attack_type"))
    blocked = F.count_if(F.col("status") == 403)
    return ok.groupBy(name.alias("attack_type")).agg(
        F.count("*").alias("total"),
        blocked.alias("blocked"),
        F.round(ratio(blocked * 100, F.count("*")), 6).alias("rate"),
    )


def metric_delta(df: DataFrame, stored: Mapping[str, float] = V.STORED_BASELINE) -> DataFrame:
    """Current F1, FPR, FNR and AUC against stored values."""
    current = binary_metrics(confusion(df), 6).select("f1", "fpr", "fnr")
    area = auc(df).select("auc").scalar()
    rows = [
        {"metric": F.lit(m), "old_value": F.lit(old), "new_value": area if m == "auc" else F.col(m)}
        for m, old in stored.items()
    ]
    return to_rows(current, rows).withColumn("delta", F.round(F.col("new_value") - F.col("old_value"), 6))


def label_balance(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum("is_attack").cast("long").alias("positives"),
        F.round(F.avg("is_attack"), 6).alias("rate"),
    )


def importance_cumulative(importance: DataFrame) -> DataFrame:
    """Share and running share of each feature; one row per feature, so one task holds them all."""
    order = W.orderBy(F.desc("importance"), F.asc("feature"))
    total = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    running = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return importance.select(
        F.row_number().over(order).alias("rank"),
        "feature",
        "importance",
        F.round(ratio(F.col("importance") * 100, total), 6).alias("pct"),
        F.round(ratio(running * 100, total), 6).alias("cumulative_pct"),
    )
