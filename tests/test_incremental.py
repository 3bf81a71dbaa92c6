import os

import pytest

from logsieve.operators.labeling import label_requests
from logsieve.sources import incremental, logs


def lines(k, n):
    paths = ["/", "/.env", "/admin", "/?id=1=1"]
    return "".join(f'10.0.{i}.{k} - - [01/Jan/2024:00:00:{i % 60:02d} +0000] "GET {paths[(i + k) % 4]} HTTP/1.1" 200 {i} "-" "Mozilla"\n' if i % 5 else f"broken {i}\n" for i in range(n))


def rows(df):
    return sorted(map(str, df.drop("log").select("row_id", "source", "path", "ip", "attack_type").collect()))


def listing(folder):
    return {(d, f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def logs_in(tmp_path):
    for name, k, n in (("www-1.log", 1, 30), ("data-1.log", 2, 20)):
        (tmp_path / name).write_text(lines(k, n))
    return tmp_path, {"www": f"{tmp_path}/www-*.log", "data": f"{tmp_path}/data-*.log", "none": f"{tmp_path}/none.log"}


def test_added_files_equal_a_full_run(spark, logs_in):
    folder, sites = logs_in
    out = f"{folder}/out"
    assert incremental.update(spark, sites, out) == 2
    full = rows(label_requests(logs.parse_log(logs.read_log_lines(spark, sites))))
    assert rows(spark.read.parquet(f"{out}/labeled")) == full and len(full) == 40
    before = listing(f"{out}/labeled") | listing(f"{out}/parsed")

    (folder / "data-2.log").write_text(lines(3, 25))
    (folder / "data-3.log").write_text("")  # no input until it holds something
    assert incremental.update(spark, sites, out) == 1
    assert rows(spark.read.parquet(f"{out}/labeled")) == rows(label_requests(logs.parse_log(logs.read_log_lines(spark, sites))))
    after = listing(f"{out}/labeled") | listing(f"{out}/parsed")
    assert before.items() <= after.items()

    assert incremental.update(spark, sites, out) == 0
    assert listing(f"{out}/labeled") | listing(f"{out}/parsed") == after
    (folder / "data-3.log").write_text(lines(4, 10))
    assert incremental.update(spark, sites, out) == 1
    assert rows(spark.read.parquet(f"{out}/labeled")) == rows(label_requests(logs.parse_log(logs.read_log_lines(spark, sites))))


def test_changed_files_replace_their_rows_alone(spark, logs_in):
    folder, sites = logs_in
    out = f"{folder}/out"
    incremental.update(spark, sites, out)
    kept = rows(spark.read.parquet(f"{out}/labeled").where("source = 'data'"))
    (folder / "www-1.log").write_text(lines(1, 60))
    assert incremental.update(spark, sites, out) == 1
    table = spark.read.parquet(f"{out}/labeled")
    assert rows(table.where("source = 'data'")) == kept
    assert [(r.a, r.b, r.n) for r in table.where("source = 'www'").selectExpr("min(row_id) a", "max(row_id) b", "count(*) n").collect()] == [(51, 109, 48)]
    assert [(r.first_id, r.lines, r.run) for r in incremental.manifest(spark, out).orderBy("first_id").collect()] == [(30, 20, 1), (50, 60, 2)]


def test_a_broken_run_is_repeated(spark, logs_in, monkeypatch):
    folder, sites = logs_in
    out = f"{folder}/out"
    incremental.update(spark, sites, out)
    (folder / "www-2.log").write_text(lines(4, 15))
    monkeypatch.setattr(incremental, "label_requests", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        incremental.update(spark, sites, out)
    monkeypatch.undo()
    assert incremental.update(spark, sites, out) == 1
    found = spark.read.parquet(f"{out}/labeled")
    assert found.count() == found.select("row_id").distinct().count() == spark.read.parquet(f"{out}/parsed").count() == 40 + 12


def test_no_inputs(spark, tmp_path):
    assert incremental.update(spark, {"www": f"{tmp_path}/none.log"}, f"{tmp_path}/out") == 0
