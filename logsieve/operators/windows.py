"""Per-client 60-second features that hold when one client sends a large part of all requests.

A window over a whole client would put that client's history into one task. Instead the work is split in two:

* inside one (client, second): position, errors and repeats up to the row. Rows are hash-partitioned by client *and*
  second, so a busy client spreads over as many tasks as it has seconds. Rows pass twice, once with the few columns that
  the totals need and once whole;
* between seconds: one row per (client, second) with its totals, ordered inside (client, day). That is at most 86,400
  rows in a task's group, whatever a client's traffic and however long the log, and a frame covers at most 60 of them.

The frame is left-open, (t - 60 s, t], and a row does not see later rows of its own second (order: row id).
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["ip", "_second"]
BUCKET = 86_400


def _rows_in_second(df: DataFrame) -> DataFrame:
    """Running values of each row inside its own second. Rows without a time get a cell of their own."""
    cell = W.partitionBy(*CELL).orderBy("row_id")
    so_far = cell.rowsBetween(W.unboundedPreceding, W.currentRow)
    keyed = df.withColumns(
        {"_second": F.coalesce(F.col("event_s"), -1 - F.col("row_id")), "_path": F.coalesce("path", F.lit(""))}
    )
    is_404 = F.coalesce((F.col("status") == 404).cast("long"), F.lit(0))
    stepped = keyed.withColumns(
        {
            "_pos": F.row_number().over(cell),
            "_err": F.sum(is_404).over(so_far),
            "_prev": F.lag("_path").over(cell),
        }
    )
    repeat = F.coalesce((F.col("_path") == F.col("_prev")).cast("long"), F.lit(0))
    return stepped.withColumns({"_repeat": repeat, "_repeats": F.sum(repeat).over(so_far)})


def _between_seconds(rows: DataFrame, seconds: int, bucket: int) -> DataFrame:
    """Per (client, second): sums over the earlier seconds of the frame, and what the second before ended with.

    Totals are ordered inside (client, bucket). A bucket gets the last path of the one before it, and the totals of the
    seconds just before it as context, which only frames see.
    """
    totals = (
        rows.filter(F.col("event_s").isNotNull())
        .groupBy(*CELL)
        .agg(
            F.count("*").alias("_n"),
            F.max("_err").alias("_n404"),
            F.max("_repeats").alias("_inner"),
            F.min_by("_path", "row_id").alias("_first"),
            F.max_by("_path", "row_id").alias("_last"),
        )
        .withColumn("_bucket", F.floor(F.col("_second") / bucket))
    )
    # one row per client and bucket
    ends = totals.groupBy("ip", "_bucket").agg(F.max_by("_last", "_second").alias("_end"))
    carried = F.lag("_end").over(W.partitionBy("ip").orderBy("_bucket"))
    ends = ends.select("ip", "_bucket", carried.alias("_carried"))
    by_bucket = W.partitionBy("ip", "_bucket").orderBy("_second")
    before = F.coalesce(F.lag("_last").over(by_bucket), F.col("_carried"))
    linked = totals.join(ends, ["ip", "_bucket"]).withColumn("_before", before)
    linked = linked.withColumn("_joins", F.coalesce((F.col("_first") == F.col("_before")).cast("long"), F.lit(0)))

    late = F.col("_second") >= (F.col("_bucket") + 1) * bucket - (seconds - 1)
    own = linked.withColumn("_own", F.lit(True))
    context = linked.filter(late).withColumns({"_bucket": F.col("_bucket") + 1, "_own": F.lit(False)})
    earlier = by_bucket.rangeBetween(-(seconds - 1), -1)
    framed = own.unionByName(context).select(
        *CELL,
        "_own",
        "_before",
        "_joins",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_earlier"),
        F.coalesce(F.sum("_n404").over(earlier), F.lit(0)).alias("_err_earlier"),
        F.coalesce(F.sum(F.col("_inner") + F.col("_joins")).over(earlier), F.lit(0)).alias("_rep_earlier"),
    )
    return framed.filter("_own").drop("_own")


def _joined(df: DataFrame, seconds: int, bucket: int) -> DataFrame:
    if bucket < seconds:
        raise ValueError("a bucket is at least as long as the frame")
    # The totals side reads only what it needs (client, time, row id, path, status).
    slim = df.select("row_id", "ip", "event_s", "path", "status")
    between = _between_seconds(_rows_in_second(slim), seconds, bucket)
    # Rows are already partitioned and sorted by the join key; only the totals move.
    return _rows_in_second(df).join(between, CELL, "left")


def add_window_features(df: DataFrame, seconds: int = 60, bucket: int = BUCKET) -> DataFrame:
    """Add ``req_count_60s``, ``err_count_60s`` and ``unique_url_60s``.

    Needs ``row_id, ip, event_s, path, status``. The last one is requests minus repeats of the client's previous
    path, at least 1. Rows without a time get 0 in all three.
    """
    requests = F.col("_n_earlier") + F.col("_pos")
    errors = F.col("_err_earlier") + F.col("_err")
    repeats = F.col("_rep_earlier") + F.col("_joins") + F.col("_repeats")
    timed = F.col("event_s").isNotNull()
    return _joined(df, seconds, bucket).select(
        *df.columns,
        F.when(timed, requests).otherwise(0).cast("int").alias("req_count_60s"),
        F.when(timed, errors).otherwise(0).cast("int").alias("err_count_60s"),
        F.when(timed, F.greatest(F.lit(1), requests - repeats)).otherwise(0).cast("int").alias("unique_url_60s"),
    )


def add_previous_path(df: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Add the client's previous path and ``same_url``, 1 when this path repeats it."""
    first = F.col("_pos") == 1
    return _joined(df, 60, bucket).select(
        *df.columns,
        F.when(first, F.col("_before")).otherwise(F.col("_prev")).alias("prev_path"),
        F.when(first, F.coalesce("_joins", F.lit(0))).otherwise(F.col("_repeat")).cast("int").alias("same_url"),
    )
