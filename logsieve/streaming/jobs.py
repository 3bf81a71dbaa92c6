"""Continuous twins of the batch operators.

Each job takes its source as a streaming DataFrame or a folder, keeps its progress in a checkpoint on shared
storage, and by default drains what is there and stops (``availableNow``).
"""

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.functions.rules import Rule
from logsieve.operators.bans import ban_triggers, error_seconds, merge_triggers
from logsieve.operators.labeling import label_requests
from logsieve.operators.windows import add_window_features
from logsieve.sources.logs import number_lines, parse_log, with_block

REQUEST_COLUMNS = ["row_id", "ip", "event_s", "path", "status"]


# --- parse and label --------------------------------------------------------------


def run_label_stream(
    spark: SparkSession, sites: dict[str, str], target: str, state: str, checkpoint: str, rules: Sequence[Rule] | None = None,
    trigger: dict[str, Any] | None = None,
) -> None:
    """Parsed, labelled requests of text files as they arrive; ``sites`` maps a source tag to a folder.

    The columns are those of the batch operators. Row ids go on from one micro-batch to the next, so the output can be
    joined, sampled and windowed like a batch table. Outputs are stored by batch number.
    """

    def process(batch: DataFrame, number: int) -> None:
        carried = _previous(batch, state, number)
        first = carried.first()["next"] if carried is not None else 0
        label_requests(parse_log(number_lines(batch, first)), rules).write.mode("overwrite").parquet(f"{target}/batch={number}")
        following = batch.sparkSession.createDataFrame([(first + batch.count(),)], "next long")
        following.write.mode("overwrite").parquet(_slot(state, number))

    frames = [with_block(spark.readStream.text(path), tag, place) for place, (tag, path) in enumerate(sites.items())]
    _run_batches(reduce(DataFrame.unionByName, frames), process, checkpoint, trigger)


# --- rate limit -------------------------------------------------------------------


def run_rate_limit(
    requests: DataFrame, target: str, checkpoint: str, limit: int = V.RATE_LIMIT_PER_MINUTE, delay: str = "1 minute",
    trigger: dict[str, Any] | None = None,
) -> None:
    """Minutes above ``limit`` as they are counted, those still open at the end included; see ``rate_limits``.

    Each micro-batch stores the counts that it changed by batch number. Rows later than ``delay`` are not counted.
    """

    def process(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = rate_limit_stream(requests, limit, delay=delay)
    _run_batches(stream, process, checkpoint, trigger, "update")


def rate_limits(spark: SparkSession, target: str) -> DataFrame:
    """The last count of every client and minute that ``run_rate_limit`` stored."""
    return spark.read.parquet(target).groupBy("ip", "window_start").agg(F.max("requests").alias("requests"))


def rate_limit_stream(
    requests: DataFrame, limit: int = V.RATE_LIMIT_PER_MINUTE, slide: str | None = None, delay: str = "1 minute"
) -> DataFrame:
    """Clients above ``limit`` requests in a minute; tumbling, or sliding by ``slide``. Needs ``event_time``."""
    minute = F.window("event_time", "1 minute", slide)
    return (
        requests.withWatermark("event_time", delay)
        .groupBy("ip", minute)
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select("ip", F.unix_timestamp("window.start").alias("window_start"), "requests")
    )


# --- micro-batches with a carried table --------------------------------------------


def _slot(state: str, number: int) -> str:
    """Folder of what a micro-batch carries over. There are two, written in turn: a batch that is run again still finds
    what the one before it left, and older state is overwritten."""
    return f"{state}/slot={number % 2}"


def _previous(batch: DataFrame, state: str, number: int) -> DataFrame | None:
    """What the micro-batch before this one carried over."""
    return batch.sparkSession.read.parquet(_slot(state, number - 1)) if number > 0 else None


def ordered(
    process: Callable[[DataFrame, int], None], state: str, late: str, delay: int
) -> Callable[[DataFrame, int], None]:
    """``process`` with its rows in order of time: each is handed on once the newest second seen is ``delay`` after its own.

    A row whose second has been handed on before is late: it goes to ``late`` by batch number instead. Newer rows are held
    back in ``state``, which grows with the rows of ``delay`` seconds. Rows without a time are handed on at once.
    """

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        second = F.col("event_s")
        before = session.read.parquet(_slot(f"{state}/mark", number - 1)).first()["mark"] if number > 0 else None
        is_late = F.coalesce(second <= F.lit(before).cast("long"), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={number}")
        known = batch.filter(~is_late)
        held = _previous(batch, f"{state}/held", number)
        if held is not None:
            known = known.unionByName(held)
        newest = known.agg(F.max(second)).first()[0]
        marks = [m for m in (before, None if newest is None else newest - delay) if m is not None]
        mark = max(marks, default=None)
        turn = F.coalesce(second <= F.lit(mark).cast("long"), second.isNull())
        process(known.filter(turn), number)
        known.filter(~turn).write.mode("overwrite").parquet(_slot(f"{state}/held", number))
        one = session.createDataFrame([(mark,)], "mark long")
        one.write.mode("overwrite").parquet(_slot(f"{state}/mark", number))

    return run


def late_counts(spark: SparkSession, late: str) -> DataFrame:
    """Late rows per micro-batch, those without any left out."""
    return spark.read.parquet(late).groupBy("batch").agg(F.count("*").alias("late"))


def _timely(
    process: Callable[[DataFrame, int], None], state: str, late: str | None, delay: int | None
) -> Callable[[DataFrame, int], None]:
    if delay is None:
        return process
    if late is None:
        raise ValueError("a delay needs a folder for late rows")
    return ordered(process, f"{state}/order", late, delay)


def _run_batches(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None,
    mode: str = "append",
) -> None:
    def kept(batch: DataFrame, number: int) -> None:
        batch.persist()  # read several times; the source is read once
        try:
            process(batch, number)
        finally:
            batch.unpersist()

    (
        stream.writeStream.foreachBatch(kept)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
        .awaitTermination()
    )


# --- bans -------------------------------------------------------------------------


def run_ban_stream(
    requests: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    errors: int = V.BAN_AFTER_ERRORS,
    period: int = V.BAN_SECONDS,
    ban: int = V.BAN_SECONDS,
    trigger: dict[str, Any] | None = None,
    delay: int | None = None,
    late: str | None = None,
) -> None:
    """New and extended bans ``ip, ban_start, ban_end`` of each micro-batch of ``ip, event_s, status``.

    Carried from batch to batch: error counts per client and second of the last ``period``, and the bans that
    ended no longer ago than that. Outputs are stored by batch number, which makes retries idempotent; the latest
    row of a (client, start) holds. With ``delay``, rows are taken in order of time and late ones go to ``late``.
    """

    def process(batch: DataFrame, number: int) -> None:
        fresh = error_seconds(batch).select("ip", "event_s", "n", F.lit(None).cast("long").alias("since"))
        carried = _previous(batch, state, number)
        known = fresh if carried is None else fresh.unionByName(carried)
        seconds = known.filter("since IS NULL").groupBy("ip", "event_s").agg(F.sum("n").alias("n"))
        # A known ban counts as one more trigger, at the second that set its end.
        running = known.filter("since IS NOT NULL").select("ip", "event_s", "since")
        triggers = ban_triggers(seconds, errors, period).withColumn("since", F.col("event_s")).unionByName(running)
        bans = merge_triggers(triggers, ban).select("ip", "ban_start", "ban_end")
        before = running.select("ip", F.col("since").alias("ban_start"), (F.col("event_s") + ban).alias("ban_end"))
        changed = bans.join(before, ["ip", "ban_start", "ban_end"], "left_anti")
        changed.write.mode("overwrite").parquet(f"{target}/batch={number}")

        newest = seconds.agg(F.max("event_s")).scalar()
        keep = seconds.select("ip", "event_s", "n", F.lit(None).cast("long").alias("since")).unionByName(
            bans.select("ip", (F.col("ban_end") - ban).alias("event_s"), F.lit(0).alias("n"), F.col("ban_start").alias("since"))
        )
        recent = F.when(F.col("since").isNull(), F.col("event_s")).otherwise(F.col("event_s") + ban)
        keep.filter(recent > newest - period).write.mode("overwrite").parquet(_slot(state, number))

    _run_batches(requests.select("ip", "event_s", "status"), _timely(process, state, late, delay), checkpoint, trigger)


# --- live window features ------------------------------------------------------------


def run_live_features(
    requests: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    seconds: int = 60,
    trigger: dict[str, Any] | None = None,
    delay: int | None = None,
    late: str | None = None,
) -> None:
    """60-second features of a stream of requests (``row_id, ip, event_s, path, status``).

    Every micro-batch runs the batch operator over its rows and a context kept from earlier ones: the rows of the
    last ``seconds``, and each client's latest row, so the state grows with the number of clients. A client that sends
    most of a micro-batch is spread the same way. Outputs are stored by batch number, which makes retries
    idempotent. Rows count what has arrived before them; with ``delay`` (see ``ordered``) that is what the batch
    operator counts over all rows that were in time.
    """

    def process(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("is_new", F.lit(True))
        carried = _previous(batch, state, number)
        known = fresh if carried is None else fresh.unionByName(carried.withColumn("is_new", F.lit(False)))
        add_window_features(known, seconds).filter("is_new").drop("is_new").write.mode("overwrite").parquet(
            f"{target}/batch={number}"
        )
        newest = known.agg(F.max("event_s")).scalar()
        rows = known.select(*REQUEST_COLUMNS).filter(F.col("event_s").isNotNull())
        row = F.struct(*REQUEST_COLUMNS)
        # the row before the oldest of the window tells whether that one repeats its path, so every client keeps one
        latest = (
            rows.filter(F.col("event_s") <= newest - seconds)
            .groupBy("ip")
            .agg(F.max_by(row, F.struct("event_s", "row_id")).alias("r"))
            .select("r.*")
        )
        window = rows.filter(F.col("event_s") > newest - seconds)
        window.unionByName(latest).write.mode("overwrite").parquet(_slot(state, number))

    _run_batches(requests.select(*REQUEST_COLUMNS), _timely(process, state, late, delay), checkpoint, trigger)
