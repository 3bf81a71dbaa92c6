"""Tables that an operator writes for itself, always below the shared folder of the session."""

import os
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.session import work_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """For code in tasks: file system and path of a folder named by URI (file, hdfs, s3, gs) or by a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here, and a lost executor takes no part of it along."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows with one row per key, where a key may hold a large share of ``left``.

    ``right`` mostly comes out of an aggregation by ``key``. Joining on that key alone would reuse the aggregation's
    partitioning, and adaptive execution could not split a hot key. A second, dependent key makes Spark exchange both
    sides, so that the hot partition of ``left`` is split over tasks at run time. Null keys match nothing.
    """
    split = F.xxhash64(key)
    return left.withColumn("_split", split).join(right.withColumn("_split", split), [key, "_split"], how).drop("_split")
