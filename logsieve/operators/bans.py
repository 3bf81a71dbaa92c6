"""Rate limits and temporary bans, as batch twins of the online layers."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V


def rate_limited(df: DataFrame, limit: int = V.RATE_LIMIT_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """Clients and minutes with more than ``limit`` requests."""
    start = F.expr(f"event_s DIV {int(seconds)} * {int(seconds)}")
    return (
        df.filter(F.col("event_s").isNotNull())
        .groupBy("ip", start.alias("window_start"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
    )


def error_seconds(df: DataFrame) -> DataFrame:
    """4xx answers per client and second: at most one row per second whatever a client sends."""
    failed = df.filter(F.col("status").between(400, 499) & F.col("event_s").isNotNull())
    return failed.groupBy("ip", "event_s").agg(F.count("*").alias("n"))


BUCKET = 86_400


def ban_triggers(per_second: DataFrame, errors: int, period: int, bucket: int = BUCKET) -> DataFrame:
    """Seconds at which a client reaches ``errors`` within ``period``.

    Each row holds an error, so the last ``errors`` rows are enough to decide whether the period holds that many. Rows are
    ordered inside (client, bucket); the last ``period`` seconds of a bucket are context of the next one.
    """
    length = max(bucket, period)
    own = per_second.select("ip", "event_s", "n", F.floor(F.col("event_s") / length).alias("_bucket"), F.lit(True).alias("_own"))
    late = own.filter(F.col("event_s") > (F.col("_bucket") + 1) * length - period)
    rows = own.unionByName(late.withColumns({"_bucket": F.col("_bucket") + 1, "_own": F.lit(False)}))
    client = W.partitionBy("ip", "_bucket").orderBy("event_s")
    recent = F.collect_list(F.struct("event_s", "n")).over(client.rowsBetween(-(errors - 1), W.currentRow))
    in_period = F.aggregate(
        "recent",
        F.lit(0).cast("long"),
        lambda total, r: total + F.when(r["event_s"] > F.col("event_s") - period, r["n"]).otherwise(0),
    )
    return rows.withColumn("recent", recent).filter(F.col("_own") & (in_period >= errors)).select("ip", "event_s")


def _islands(rows: DataFrame, ban: int, *group: str) -> DataFrame:
    """Rows (first, last, since, triggers) that follow each other by less than ``ban`` joined into one, inside each group."""
    order = W.partitionBy(*group).orderBy("first")
    fresh = (F.col("first") - F.lag("last").over(order) >= ban).cast("int")
    island = F.sum(F.coalesce("fresh", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        rows.withColumn("fresh", fresh)
        .withColumn("island", island)
        .groupBy(*group, "island")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.min("since").alias("since"),
            F.sum("triggers").alias("triggers"),
        )
        .drop("island")
    )


def merge_triggers(triggers: DataFrame, ban: int, bucket: int = BUCKET) -> DataFrame:
    """Bans of triggers less than ``ban`` apart joined into one. ``since`` is the start of a ban already running.

    Triggers are joined inside (client, bucket) first. What is left to order by client alone are those joined bans, at most
    one per ``ban`` seconds.
    """
    single = triggers.select(
        "ip", F.floor(F.col("event_s") / bucket).alias("_bucket"), F.col("event_s").alias("first"), F.col("event_s").alias("last"),
        F.least("since", "event_s").alias("since"), F.lit(1).alias("triggers"),
    )
    merged = _islands(_islands(single, ban, "ip", "_bucket").drop("_bucket"), ban, "ip")
    return merged.select("ip", F.col("since").alias("ban_start"), (F.col("last") + ban).alias("ban_end"), "triggers")


def ban_windows(
    df: DataFrame, errors: int = V.BAN_AFTER_ERRORS, period: int = V.BAN_SECONDS, ban: int = V.BAN_SECONDS, bucket: int = BUCKET
) -> DataFrame:
    """Bans ``[ban_start, ban_end)`` per client: at ``errors`` 4xx within ``period`` a ban of ``ban`` seconds
    starts, and a new trigger inside it extends it."""
    triggers = ban_triggers(error_seconds(df), errors, period, bucket)
    return merge_triggers(triggers.withColumn("since", F.col("event_s")), ban, bucket)


def mark_banned(df: DataFrame, bans: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Add ``banned``, 1 for requests inside a ban of their client.

    An interval join on (client, hour): a ban is repeated for each hour it touches, so the join is an equi-join
    and a busy client's requests spread over hours. Bans of one client do not overlap, so rows never multiply.
    """
    hour = f"DIV {int(slice_seconds)}"
    sliced = bans.select(
        "ip",
        "ban_start",
        "ban_end",
        F.explode(F.expr(f"sequence(ban_start {hour}, (ban_end - 1) {hour})")).alias("_slice"),
    )
    requests = df.withColumn("_slice", F.expr(f"event_s {hour}")).alias("r")
    inside = (
        (F.col("r.ip") == F.col("b.ip"))
        & (F.col("r._slice") == F.col("b._slice"))
        & (F.col("r.event_s") >= F.col("b.ban_start"))
        & (F.col("r.event_s") < F.col("b.ban_end"))
    )
    return requests.join(sliced.alias("b"), inside, "left").select(
        *[F.col(f"r.{c}") for c in df.columns], F.col("b.ban_start").isNotNull().cast("int").alias("banned")
    )
