"""Parquet tables on shared storage."""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("source",)) -> None:
    """Large tables: Parquet, one folder per site, written by all tasks."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` once under ``folder`` (shared storage) and read it back: a cut in lineage that lost executors
    cannot undo."""
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "row_id") -> DataFrame:
    """Write ``df`` in ``buckets`` files, dealt by a hash of ``key`` and sorted by it, and open it.

    Tables of one number of buckets join on the key without a shuffle, every time they are used. The number is chosen so that a
    file of the largest table fits a task.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # the writer's own hash: each task writes one file
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, buckets: int, key: str = "row_id") -> DataFrame:
    """A table of ``write_bucketed`` in another session, whose catalog does not know it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = spark.read.parquet(path).schema.toDDL()
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
