"""Exact order statistics without a global sort in one task.

Values are first counted (equal values collapse before the shuffle), then dealt by value range over the shuffle
partitions; ranges are prefix-summed over one row each and values only inside their range.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.session import checkpoint


def counts_below(
    df: DataFrame, value: str, counts: Mapping[str, Column], groups: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, value): each count, and ``<count>_below``, its sum over smaller values of the group.

    This is a job, not a lazy frame: the counted values are checkpointed in the shared folder, so that ``df`` is scanned
    a single time and every later step sees the same ranges. Spark removes the checkpoint once nothing refers to it.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        *[c.alias(name) for name, c in counts.items()]
    )
    ranged = checkpoint(counted.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()))

    by_range = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*groups, "_range")
        .agg(*[F.sum(name).alias(name) for name in counts])
        .select(*groups, "_range", *[F.coalesce(F.sum(n).over(by_range), F.lit(0)).alias(f"_{n}_start") for n in counts])
    )
    inside = W.partitionBy(*groups, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = [
        (F.col(f"_{n}_start") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below") for n in counts
    ]
    return ranged.join(starts, [*groups, "_range"]).select(*groups, value, *counts, *below)


def auc(scored: DataFrame, score: str = "score", label: str = "is_attack") -> DataFrame:
    """ROC-AUC with ties counted half; 0 rows of either class give NULL."""
    ranked = counts_below(
        scored,
        score,
        {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)},
    )
    # Twice the number of (positive, negative) pairs in order, as an exact decimal.
    pairs = F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)")
    sums = ranked.agg(F.sum(pairs).alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    area = F.col("pairs").cast("double") / (2.0 * F.col("pos").cast("double") * F.col("neg").cast("double"))
    return sums.select(
        F.col("pos").alias("positives"),
        F.col("neg").alias("negatives"),
        F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), area), 6).alias("auc"),
    )


def distribution(
    df: DataFrame, value: str, group: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9)
) -> DataFrame:
    """Per group: n, mean, sample deviation, min, max and linearly interpolated quantiles."""
    number = F.col(value).cast("double")
    ranked = counts_below(df.select(group, number.alias("_v")), "_v", {"n": F.count("*")}, [group])
    totals = ranked.groupBy(group).agg(
        F.sum("n").alias("_total"),
        (F.sum(F.col("n") * F.col("_v")) / F.sum("n")).alias("_mean"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    placed = ranked.join(totals, group)

    def at(position: Column) -> Column:
        here = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))
        return F.max(F.when(here, F.col("_v")))

    picks = []
    for i, q in enumerate(quantiles):
        spot = (F.col("_total") - 1) * F.lit(float(q))
        picks += [
            at(F.floor(spot)).alias(f"_lo{i}"),
            at(F.ceil(spot)).alias(f"_hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"_w{i}"),
        ]
    squares = F.sum(F.col("n") * F.pow(F.col("_v") - F.col("_mean"), 2))
    picked = placed.groupBy(group, "_total", "_mean", "_min", "_max").agg(squares.alias("_squares"), *picks)
    deviation = F.when(F.col("_total") > 1, F.sqrt(F.col("_squares") / (F.col("_total") - 1)))
    named = [
        F.round(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}"), 6).alias(
            f"p{int(round(q * 100))}"
        )
        for i, q in enumerate(quantiles)
    ]
    return picked.select(
        group,
        F.col("_total").alias("n"),
        F.round("_mean", 6).alias("mean"),
        F.round(deviation, 6).alias("std"),
        F.round("_min", 6).alias("min"),
        F.round("_max", 6).alias("max"),
        *named,
    )


def short_share(df: DataFrame, value: str, group: str, limit: int) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col(value) < limit).cast("double")), 6).alias("short_share"),
    )
