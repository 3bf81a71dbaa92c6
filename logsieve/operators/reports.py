"""Counts, shares and mean comparisons shared by the reports."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def value_counts(df: DataFrame, column: Column | str, name: str, top: int | None = None) -> DataFrame:
    """Rows and share of each value; ``top`` keeps the most frequent, ties by name."""
    column = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
    # The total comes from the counts, one row per distinct value, by a scalar sub-query; no global window.
    total = counts.agg(F.sum("n").alias("t")).scalar()
    shares = counts.withColumn("share", F.round(F.col("n") / total, 6))
    return shares.orderBy(F.desc("n"), F.asc(name)).limit(top) if top else shares


def to_rows(wide: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn the columns of a small (already aggregated) table into rows, one per mapping."""
    packed = F.array(*[F.struct(*[c.alias(k) for k, c in row.items()]) for row in rows])
    return wide.select(F.explode(packed).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in ``order``.

    Spark limits each group inside the map tasks first, so that a group holding most rows still ships at most
    ``n`` rows per task.
    """
    window = W.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def top_values(df: DataFrame, column: Column, name: str, n: int) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(name)).limit(n)


def breakdown(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """Counts and shares along several dimensions in one scan."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("value")) for k, c in dimensions.items()])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    # Every row appears once per dimension, so the scanned rows are the total of any one of them.
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("_total"))
    joined = counts.join(totals, "dimension")
    return joined.select("dimension", "value", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def group_means(df: DataFrame, features: Sequence[str], left: str, right: str, names: tuple[str, str]) -> DataFrame:
    """Mean of every feature over two row groups (SQL conditions), in one aggregation of one scan."""
    aggregated = df.selectExpr(
        *[f"avg(CASE WHEN {left} THEN {f} END) AS l_{f}" for f in features],
        *[f"avg(CASE WHEN {right} THEN {f} END) AS r_{f}" for f in features],
    )
    rows = ", ".join(f"'{f}', l_{f}, r_{f}" for f in features)
    return aggregated.selectExpr(f"stack({len(features)}, {rows}) AS (feature, {names[0]}, {names[1]})")
