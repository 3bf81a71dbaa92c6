"""Access-log text: scan, parse, account for bad lines."""

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V

SEPARATOR = "\u0001"
LINE_HEAD = r"^\s*" + V.LOG_LINE


def existing_text(spark: SparkSession, path: str) -> DataFrame | None:
    """The text files of a path or glob, or None where nothing matches."""
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def with_block(text: DataFrame, tag: str, place: int = 0) -> DataFrame:
    """Lines of text files as ``(source, value, _block)``; the block tells where in which file a line was read."""
    block = F.struct(
        F.lit(place).alias("site"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    return text.select(F.lit(tag).alias("source"), F.make_valid_utf8("value").alias("value"), block.alias("_block"))


def number_lines(lines: DataFrame, first: int = 0, keep: Sequence[str] = ("source", "value")) -> DataFrame:
    """``row_id`` and the columns ``keep``, with line numbers from ``first`` on, in the order of blocks and of lines in a block.

    Lines are numbered inside each block as it is read, and the blocks' line counts, one row per block, are added up.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy("_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + first
    starts = blocks.select("_block", shift.alias("_shift"))
    return placed.join(starts, "_block").select((F.col("_at") + F.col("_shift")).alias("row_id"), *keep)


def read_log_lines(spark: SparkSession, sites: dict[str, str]) -> DataFrame:
    """Lines of each site's log as ``(row_id, source, value)``; sites whose files are missing are skipped.

    ``sites`` maps a source tag to a path or glob. Bytes that are not UTF-8 become the replacement character.

    A row id is the line's number over all inputs: sites in the given order, files by path, lines as they stand in the
    file. It is the same however files are split into read tasks.
    """
    frames = []
    for place, (tag, path) in enumerate(sites.items()):
        text = existing_text(spark, path)
        if text is None:
            print(f"skipping missing input {path}")
            continue
        frames.append(with_block(text, tag, place))
    if not frames:
        raise FileNotFoundError(f"no log file under {sorted(sites.values())}")
    return number_lines(reduce(DataFrame.unionByName, frames))


def _fields_by_group(value: Column) -> Column:
    """The ten fields, one regex pass per field; NULL when the line does not match."""
    groups = F.transform(
        F.sequence(F.lit(1), F.lit(len(V.LOG_FIELDS))), lambda i: F.call_function("regexp_extract", value, F.lit(LINE_HEAD), i)
    )
    return F.when(value.rlike(LINE_HEAD), groups)


def _pieces(value: Column) -> Column:
    """Ten pieces when the line matches, another number or NULL when it does not.

    One regex pass rewrites a matching line to its groups around a separator; a plain split then yields the
    fields. Lines that already hold the separator character take the slower pass per field.
    """
    replacement = SEPARATOR.join(f"${i + 1}" for i in range(len(V.LOG_FIELDS)))
    joined = F.regexp_replace(value, "(?s)" + LINE_HEAD + ".*$", replacement)
    return F.when(value.contains(SEPARATOR), _fields_by_group(value)).otherwise(F.split(joined, SEPARATOR))


def _matches(pieces: Column) -> Column:
    return F.coalesce(F.size(pieces) == len(V.LOG_FIELDS), F.lit(False))


def parse_log(lines: DataFrame) -> DataFrame:
    """Typed requests of the lines that match; other columns of ``lines`` are kept."""
    kept = [c for c in lines.columns if c != "value"]
    pieces = lines.select(*kept, _pieces(F.col("value")).alias("_pieces"))
    # Exploding a one-element array drops bad lines without evaluating the regex again in a pushed-down filter.
    good = F.when(_matches(F.col("_pieces")), F.array("_pieces"))
    rows = pieces.select(*kept, F.explode(good).alias("fields"))
    raw = {name: F.get(F.col("fields"), i) for i, name in enumerate(V.LOG_FIELDS)}
    typed = rows.select(
        *kept,
        raw["ip"].alias("ip"),
        F.nullif(raw["user"], F.lit("-")).alias("user"),
        raw["time"].alias("time"),
        raw["method"].alias("method"),
        raw["path"].alias("path"),
        raw["protocol"].alias("protocol"),
        raw["status"].try_cast("int").alias("status"),
        raw["size"].try_cast("long").alias("size"),
        raw["referer"].alias("referer"),
        raw["user_agent"].alias("user_agent"),
        F.try_to_timestamp(raw["time"], F.lit(V.LOG_TIME)).alias("event_time"),
    )
    return typed.withColumn("event_s", F.unix_timestamp("event_time"))


def parse_stats(lines: DataFrame) -> DataFrame:
    """Per source: lines seen, parsed, failed, and parsed lines whose time cannot be read."""
    pieces = lines.select("source", _pieces(F.col("value")).alias("_pieces"))
    marked = pieces.select("source", "_pieces", _matches(F.col("_pieces")).alias("ok"))
    stamp = F.try_to_timestamp(F.get("_pieces", F.lit(V.LOG_FIELDS.index("time"))), F.lit(V.LOG_TIME))
    return marked.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("parsed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok") & stamp.isNull()).alias("bad_time"),
    )
