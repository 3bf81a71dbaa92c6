import pytest

from logsieve.sources.logs import parse_log, parse_stats, read_log_lines

GOOD = '10.0.0.7 - - [01/Jan/2024:08:00:05 +0800] "GET /a?x=1 HTTP/1.1" 200 512 "-" "curl/8"'
IPV6 = '2001:db8::1 - bob [01/Jan/2024:00:00:05 +0000] "POST /b HTTP/2.0" 404 0 "https://r/" "UA"'
ODD = '10.0.0.9 - - [01/Jan/2024:00:00:05 +0000] "GET /s\u0001x HTTP/1.1" 200 1 "-" "a\u0001b"'
LINES = [
    GOOD,
    "  " + IPV6 + "  trailing",
    ODD,
    "",
    "garbage",
    GOOD.replace('"curl/8"', '"quote " inside"'),
    GOOD.replace("01/Jan/2024:08", "99/Foo/2024:08"),
    GOOD.replace(" 200 ", " 2000 "),
    GOOD.replace("/a?x=1 ", " "),
]


def frame(spark, lines):
    return spark.createDataFrame([(i, "www", v) for i, v in enumerate(lines)], "row_id long, source string, value string")


def test_fields_and_types(spark):
    rows = {r.row_id: r for r in parse_log(frame(spark, LINES)).collect()}
    assert set(rows) == {0, 1, 2, 5, 6}
    first = rows[0]
    assert (first.ip, first.user, first.method, first.path, first.protocol) == ("10.0.0.7", None, "GET", "/a?x=1", "HTTP/1.1")
    assert (first.status, first.size, first.referer, first.user_agent) == (200, 512, "-", "curl/8")
    assert first.event_s == 1704067205
    assert (rows[1].ip, rows[1].user, rows[1].status) == ("2001:db8::1", "bob", 404)
    assert rows[5].user_agent == "quote "


def test_line_holding_the_separator_keeps_its_text(spark):
    row = parse_log(frame(spark, [ODD])).first()
    assert row.path == "/s\u0001x" and row.user_agent == "a\u0001b"


def test_bad_time_is_kept_and_counted(spark):
    rows = {r.row_id: r for r in parse_log(frame(spark, LINES)).collect()}
    assert rows[6].event_s is None and rows[6].time.startswith("99/Foo")
    stats = parse_stats(frame(spark, LINES)).first()
    assert (stats.total, stats.parsed, stats.failed, stats.bad_time) == (9, 5, 4, 1)


def test_files_sites_and_bytes(spark, tmp_path):
    (tmp_path / "www.log").write_bytes(GOOD.encode() + b"\r\n" + GOOD.replace("curl/8", "x\xff").encode("latin-1") + b"\n")
    lines = read_log_lines(spark, {"www": str(tmp_path / "www.log"), "data": str(tmp_path / "none.log")})
    rows = parse_log(lines).orderBy("row_id").collect()
    assert [r.source for r in rows] == ["www", "www"]
    assert rows[1].user_agent == "x�"
    with pytest.raises(FileNotFoundError):
        read_log_lines(spark, {"data": str(tmp_path / "none.log")})


def test_row_ids_do_not_depend_on_read_splits(spark, tmp_path):
    for site, lines in {"a": 1, "b": 3000, "c": 500}.items():
        (tmp_path / f"{site}.log").write_text("".join(GOOD.replace("/a?x=1", f"/{site}{i}") + "\n" for i in range(lines)))
    seen = []
    for size in ("1k", "17k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = read_log_lines(spark, {"www": str(tmp_path / "[ab].log"), "data": str(tmp_path / "c.log")})
        seen.append([(r.row_id, r.source, r.path) for r in parse_log(lines).orderBy("row_id").collect()])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [("www", "/a0"), *[("www", f"/b{i}") for i in range(3000)], *[("data", f"/c{i}") for i in range(500)]]
    assert seen[0] == seen[1] == seen[2] == [(i, *name) for i, name in enumerate(names)]
