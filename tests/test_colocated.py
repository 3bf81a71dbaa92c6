import pytest
from pyspark.sql import functions as F

from logsieve.operators.joins import join_colocated, join_labels
from logsieve.session import work_dir
from logsieve.sources.tables import open_bucketed, write_bucketed


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("bucketed")
    features = spark.range(3_000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("dots"))
    labels = spark.range(0, 3_000, 2).select(F.col("id").alias("row_id"), F.lit(1).alias("is_attack"), F.lit("x").alias("attack_type"))
    write_bucketed(features, f"{base}/features", 8)
    return features, labels, open_bucketed(spark, f"{base}/features", 8), write_bucketed(labels, f"{base}/labels", 8)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_no_exchange(both, how):
    features, labels, stored, marked = both
    joined = join_colocated(stored, marked, how)
    assert sorted(map(str, joined.collect())) == sorted(map(str, join_labels(features, labels, how).collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_one_file_per_bucket(both):
    assert len(both[2].inputFiles()) == 8
