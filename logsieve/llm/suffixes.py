"""Ranks of suffixes, by the order of their keys."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.work import stored


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ranks: dense, from 1 and in key order, of distinct keys.

    Keys are dealt by range, numbered inside each range, and the ranges' sizes added up, so no task sees more than its range.
    """
    dealt = stored(keys.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranks")
    inner = F.row_number().over(Window.partitionBy("range").orderBy(key))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return dealt.withColumn("inner", inner).join(sizes, "range").select(*keys.columns, (F.col("inner") + F.col("before")).alias("rank"))
