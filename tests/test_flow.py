import pytest
from pyspark.sql import functions as F

from logsieve.plans import flow
from logsieve.session import work_dir
from logsieve.sources import artifacts


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("flow")
    paths = ["/", "/about", "/.env", "/admin", "/?id=1=1", "/nacos/x", "/?and/y", "/list?p=/"]
    lines = [
        f'10.0.{i % 7}.1 - - [01/Jan/2024:00:{i // 60 % 60:02d}:{i % 60:02d} +0000] "GET {paths[i % 8]} HTTP/1.1" '
        f'{200 if i % 3 else 404} {i} "-" "{"curl/8" if i % 11 == 0 else "Mozilla"}"'
        for i in range(1600)
    ]
    (folder / "www.log").write_text("\n".join(lines))
    features = flow.prepare(spark, {"www": str(folder / "www.log"), "data": str(folder / "missing.log")}, str(folder / "o"))
    assert features.count() == 1600
    return str(folder / "o")


def test_binary_reports(spark, out):
    flow.train_binary(spark, out, maxIter=2, maxDepth=3, minInstancesPerNode=1)
    row = spark.read.option("header", True).csv(f"{out}/reports/binary-v3/metrics").first()
    scored = spark.read.parquet(f"{out}/scored-v3")
    assert int(row.tp) + int(row.fn) == scored.filter("is_attack = 1").count()
    assert scored.filter(F.col("attack_type") == "seo_spam").count() == 0
    assert spark.read.option("header", True).csv(f"{out}/reports/binary-v3/thresholds").count() == 14
    assert artifacts.load_model(spark, f"{out}/models/binary-v3").features[0] == "url_length"


def test_multiclass_reports(spark, out):
    flow.train_multiclass(spark, out, num_trees=3, max_depth=4)
    classes = artifacts.read_json_document(spark, f"{out}/models/multiclass/classes.json")["classes"]
    assert classes == sorted(classes) and "seo_spam" not in classes and "vuln_scan" in classes
    assert spark.read.option("header", True).csv(f"{out}/reports/multiclass/classes").count() >= len(classes) - 1


def test_work_dir_is_the_configured_one(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
