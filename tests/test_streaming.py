import pytest
from pyspark.sql import functions as F

from logsieve.operators.bans import ban_windows, rate_limited
from logsieve.operators.labeling import label_requests
from logsieve.operators.windows import add_window_features
from logsieve.sources.logs import parse_log, read_log_lines
from logsieve.streaming import jobs


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_labels_arrive_once_over_two_runs(spark, tmp_path):
    line = '10.0.0.7 - - [01/Jan/2024:00:00:05 +0000] "GET {} HTTP/1.1" 200 1 "-" "x"'
    parts = [["/.env", "bad", "/a"], ["/ok", "/b"]]
    source = tmp_path / "in"
    source.mkdir()
    folders = [str(tmp_path / f) for f in ("out", "state", "check")]
    for number, paths in enumerate(parts):
        lines = [line.format(p) if p.startswith("/") else p for p in paths]
        (source / f"part{number}.log").write_text("\n".join(lines) + "\n")
        jobs.run_label_stream(spark, {"www": str(source)}, *folders)
    streamed = spark.read.parquet(folders[0]).drop("batch")
    rows = streamed.orderBy("row_id").collect()
    assert [(r.row_id, r.path, r.attack_type) for r in rows] == [
        (0, "/.env", "sensitive_scan"), (2, "/a", "normal"), (3, "/ok", "normal"), (4, "/b", "normal"),
    ]
    assert streamed.columns == label_requests(parse_log(read_log_lines(spark, {"www": str(source)}))).columns


def timed(spark, tmp_path, rows, name):
    df = spark.createDataFrame(rows, "ip string, event_s long, status int")
    folder = str(tmp_path / name)
    for part in df.select("event_s").distinct().orderBy("event_s").collect():
        df.filter(F.col("event_s") == part.event_s).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ip string, event_s long, status int").option("maxFilesPerTrigger", 1).parquet(folder)
    return df, stream.withColumn("event_time", F.timestamp_seconds("event_s"))


def test_rate_limit_stream(spark, tmp_path):
    rows = [("a", s, 200) for s in (0, 1, 1, 70)] + [("b", 0, 200), ("z", 1000, 200)]
    _, stream = timed(spark, tmp_path, rows, "rate")
    assert [tuple(r) for r in drain(jobs.rate_limit_stream(stream, 2), "rate")] == [("a", 0, 3)]


def test_rate_limits_count_minutes_still_open(spark, tmp_path):
    rows = [("a", s, 200) for s in (0, 1, 1, 70, 71, 72)] + [("b", 0, 200)]
    df, stream = timed(spark, tmp_path, rows, "rates")
    folders = [str(tmp_path / f) for f in ("rate-out", "rate-check")]
    jobs.run_rate_limit(stream, *folders, limit=2)
    found = {tuple(r) for r in jobs.rate_limits(spark, folders[0]).collect()}
    assert found == {tuple(r) for r in rate_limited(df, 2).collect()} == {("a", 0, 3), ("a", 60, 3)}


def test_ban_stream_agrees_with_batch(spark, tmp_path):
    rows = [("a", s, 404) for s in (0, 1, 1, 40, 41, 300, 301, 302)] + [("b", 5, 404), ("a", 2, 200), ("z", 5000, 404)]
    df, stream = timed(spark, tmp_path, rows, "bans")
    folders = [str(tmp_path / f) for f in ("ban-out", "ban-state", "ban-check")]
    jobs.run_ban_stream(stream, *folders, errors=3, period=60, ban=100)
    last = {}
    for r in spark.read.parquet(folders[0]).collect():
        last[(r.ip, r.ban_start)] = max(r.ban_end, last.get((r.ip, r.ban_start), 0))
    expected = {(r.ip, r.ban_start): r.ban_end for r in ban_windows(df, 3, 60, 100).collect()}
    assert last == expected and len(expected) == 2


def test_live_features_agree_with_batch(spark, requests, tmp_path):
    rows = [
        {"ip": f"10.0.0.{i % 3}", "event_s": i * 7, "path": f"/{i % 2 * i}", "status": 404 if i % 4 else 200} for i in range(40)
    ] + [{"row_id": 99, "ip": "10.0.0.1", "event_s": 900, "path": "/39"}]
    df = requests(*rows).select(*jobs.REQUEST_COLUMNS)
    folder = str(tmp_path / "in")
    for low, high in ((0, 13), (13, 26), (26, 100)):
        df.filter((F.col("row_id") >= low) & (F.col("row_id") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_live_features(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "check"))
    columns = ["row_id", "req_count_60s", "err_count_60s", "unique_url_60s"]
    live = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()}
    assert live == {tuple(r) for r in add_window_features(df).select(*columns).collect()}


def test_live_features_know_the_path_before_the_window(spark, requests, tmp_path):
    """A client with rows in the window keeps the row before its oldest one, which tells whether that one repeats its path."""
    rows = [{"ip": "a", "event_s": 0, "path": "/x"}, {"ip": "a", "event_s": 50, "path": "/x"}, {"ip": "b", "event_s": 100}, {"ip": "a", "event_s": 105, "path": "/z"}]
    df = requests(*rows).select(*jobs.REQUEST_COLUMNS)
    folder = str(tmp_path / "in")
    for low, high in ((0, 3), (3, 4)):
        df.filter((F.col("row_id") >= low) & (F.col("row_id") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.run_live_features(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "check"))
    live = {r.row_id: r.unique_url_60s for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert live[3] == 1 and live == {r.row_id: r.unique_url_60s for r in add_window_features(df).collect()}


OUT_OF_ORDER = [[0, 10, 50, 30, 31], [20, 5, 90, 32, 10], [200, 45, 55, 50, 91], [80, 170, 161]]
LATE = {1: [5, 10], 2: [45, 50], 3: [80]}


def out_of_order(spark, tmp_path, requests):
    """Files of unordered seconds; with a delay of 40 the rows of LATE come after their turn, those above 160 wait."""
    rows, files = [], []
    for number, seconds in enumerate(OUT_OF_ORDER):
        for s in seconds:
            rows.append({"ip": f"10.0.0.{s % 2}", "event_s": s, "path": f"/{s % 3}", "status": 404})
            files.append(number)
    rows.append({"event_s": None})
    df = requests(*rows).select(*jobs.REQUEST_COLUMNS)
    folder = str(tmp_path / "in")
    for number in range(len(OUT_OF_ORDER)):
        ids = [i for i, f in enumerate([*files, 0]) if f == number]
        df.filter(F.col("row_id").isin(ids)).coalesce(1).write.mode("append").parquet(folder)
    late = [i for i, r in enumerate(rows[:-1]) if r["event_s"] in LATE.get(files[i], [])]
    in_time = df.filter(~F.col("row_id").isin(late) & F.coalesce(F.col("event_s") <= 160, F.lit(True)))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), in_time, late


def test_late_rows_go_aside_and_the_rest_equals_the_batch(spark, requests, tmp_path):
    stream, in_time, late = out_of_order(spark, tmp_path, requests)
    out, state, check, aside = (str(tmp_path / f) for f in ("out", "state", "check", "late"))
    jobs.run_live_features(stream, out, state, check, delay=40, late=aside)
    columns = ["row_id", "req_count_60s", "err_count_60s", "unique_url_60s"]
    live = [tuple(r) for r in spark.read.parquet(out).select(*columns).collect()]
    assert sorted(live) == sorted(tuple(r) for r in add_window_features(in_time).select(*columns).collect())
    assert sorted(r.row_id for r in spark.read.parquet(aside).collect()) == late
    assert {r.batch: r.late for r in jobs.late_counts(spark, aside).collect()} == {n: len(s) for n, s in LATE.items()}


def test_bans_count_rows_in_time(spark, requests, tmp_path):
    stream, in_time, late = out_of_order(spark, tmp_path, requests)
    out, state, check, aside = (str(tmp_path / f) for f in ("out", "state", "check", "late"))
    jobs.run_ban_stream(stream, out, state, check, errors=3, period=30, ban=20, delay=40, late=aside)
    found = spark.read.parquet(out).groupBy("ip", "ban_start").agg(F.max("ban_end").alias("ban_end"))
    expected = {tuple(r) for r in ban_windows(in_time, 3, 30, 20).select("ip", "ban_start", "ban_end").collect()}
    assert {tuple(r) for r in found.collect()} == expected and expected
    assert spark.read.parquet(aside).count() == len(late)


def test_a_delay_needs_a_place_for_late_rows(spark, requests, tmp_path):
    stream, _, _ = out_of_order(spark, tmp_path, requests)
    with pytest.raises(ValueError, match="late rows"):
        jobs.run_ban_stream(stream, *(str(tmp_path / f) for f in ("out", "state", "check")), delay=40)
