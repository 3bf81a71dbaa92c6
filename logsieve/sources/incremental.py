"""Logs taken in file by file: a manifest knows the inputs, and only new or changed files are read."""

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.rules import Rule
from logsieve.operators.labeling import label_requests
from logsieve.sources.logs import number_lines, parse_log, with_block

FILE = ["source", "file"]
ENTRY = "source string, file string, length long, modified timestamp, log string"
MANIFEST = ENTRY + ", first_id long, lines long, run long"


def _files(spark: SparkSession, sites: dict[str, str]) -> DataFrame:
    """(site, path, source, file, length, modified, log) of every input; contents are not read. ``log`` names the file's partition."""
    frames = [spark.createDataFrame([], "site int, path string, " + ENTRY)]
    for place, (tag, path) in enumerate(sites.items()):
        try:
            found = spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        file = F.col("_metadata.file_path")
        place_of = [F.lit(place).alias("site"), "path", F.lit(tag).alias("source"), file.alias("file")]
        frames.append(found.select(*place_of, "length", F.col("modificationTime").alias("modified"), F.md5(file).alias("log")))
    return reduce(DataFrame.unionByName, frames)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The latest entry of every input: what it was when it was read, the row ids of its lines and the run that read it."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    rank = F.row_number().over(W.partitionBy(*FILE).orderBy(F.desc("run")))
    return entries.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _replace(df: DataFrame, path: str) -> None:
    """Write the partitions that ``df`` has, and leave those of other files alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "log").parquet(path)


def update(spark: SparkSession, sites: dict[str, str], out: str, rules: Sequence[Rule] | None = None) -> int:
    """Bring ``parsed`` and ``labeled`` under ``out`` up to date with the logs of ``sites``; the number of files read.

    A file that is new, or whose length or time has changed, is parsed and labelled into its own partition (source, log); those
    of all other files stay as they are, and so do their row ids. Row ids are line numbers that go on from run to run: sites
    in the given order, files by path. A changed file gets new ids. A file that is gone keeps its rows, an empty one is no
    input until it grows. The manifest is written last, so
    a run that broke off is repeated with the same ids and overwrites its own partitions.
    """
    known = manifest(spark, out).select(*FILE, "length", "modified")
    # one row per new file: the reader needs their names
    listed = _files(spark, sites)
    files = listed.join(known, [*FILE, "length", "modified"], "left_anti").select(listed.columns).orderBy("site", "file").collect()
    if not files:
        return 0
    last = manifest(spark, out).agg(F.max(F.col("first_id") + F.col("lines")).alias("next"), F.max("run").alias("run")).first()
    read = []
    for place, tag in sorted({(f.site, f.source) for f in files}):
        text = spark.read.text([f.path for f in files if f.site == place])
        read.append(with_block(text, tag, place))
    placed = reduce(DataFrame.unionByName, read).withColumn("file", F.col("_block.file"))
    lines = number_lines(placed, last.next or 0, ["source", "file", "value"])

    entries = spark.createDataFrame([f[2:] for f in files], ENTRY)
    counts = lines.groupBy(*FILE).agg(F.min("row_id").alias("first_id"), F.count("*").alias("lines"))
    entries = entries.join(counts, FILE, "left").withColumn("lines", F.coalesce("lines", F.lit(0))).withColumn("run", F.lit((last.run or 0) + 1).cast("long"))
    entries = entries.select(*[part.split()[0] for part in MANIFEST.split(", ")])

    parsed = parse_log(lines.withColumn("log", F.md5("file")).drop("file"))
    _replace(parsed, f"{out}/parsed")
    fresh = spark.read.parquet(f"{out}/parsed").where(F.col("log").isin([f.log for f in files]))
    _replace(label_requests(fresh, rules), f"{out}/labeled")
    entries.write.mode("append").parquet(f"{out}/manifest")
    return len(files)
