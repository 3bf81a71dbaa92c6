from pyspark.sql import functions as F

from logsieve.operators.reports import breakdown, top_per_group, value_counts
from logsieve.operators.sampling import balanced_sample, sample_n, split_random, split_stratified, split_three


def table(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 997 == 3, "tiny").otherwise("hot").alias("attack_type"),
        (F.col("id") % 3 == 0).cast("int").alias("is_attack"),
    )


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_sample_is_exact_and_ignores_layout(spark):
    df = table(spark)
    assert ids(sample_n(df, 100)) == ids(sample_n(df.repartition(7), 100)) and len(ids(sample_n(df, 100))) == 100
    assert ids(sample_n(df, 100)) != ids(sample_n(df, 100, seed="43"))
    assert len(ids(sample_n(df, 10_000))) == 3000


def test_balanced(spark):
    counts = {r.label: r["count"] for r in balanced_sample(table(spark), 50, 70).groupBy("label").count().collect()}
    assert counts == {"attack": 50, "normal": 70}


def test_stratified_share_is_exact_per_class(spark):
    df = table(spark)
    parts = split_stratified(df)
    totals = {r.attack_type: r["count"] for r in df.groupBy("attack_type").count().collect()}
    train = {r.attack_type: r["count"] for r in parts.filter("split = 'train'").groupBy("attack_type").count().collect()}
    assert parts.count() == 3000
    assert train == {c: n * 80 // 100 for c, n in totals.items()}
    again = split_stratified(df.repartition(5))
    assert ids(parts.filter("split = 'test'")) == ids(again.filter("split = 'test'"))


def test_stratified_single_row_class_goes_to_test(spark):
    df = spark.createDataFrame([(1, "a")], "row_id long, attack_type string")
    assert split_stratified(df).first().split == "test"


def test_three_way_refines_two_way(spark):
    df = table(spark)
    two = {r.row_id: r.split for r in split_random(df).collect()}
    three = {r.row_id: r.split for r in split_three(df).collect()}
    assert all((three[i] == "test") == (two[i] == "test") for i in two)
    assert set(three.values()) == {"train", "valid", "test"}


def test_top_per_group_limits_before_the_shuffle(spark):
    best = top_per_group(table(spark), "attack_type", [F.asc("row_id")], 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2
    assert [r.row_id for r in best.filter("attack_type = 'hot'").orderBy("rank").collect()] == [1, 2, 4]


def test_counts_and_breakdown(spark):
    shares = {r.v: (r.n, r.share) for r in value_counts(table(spark), "is_attack", "v").collect()}
    assert shares == {0: (2000, 0.666667), 1: (1000, 0.333333)}
    assert value_counts(table(spark), "attack_type", "v", top=1).first().v == "hot"
    rows = breakdown(table(spark), {"a": F.col("attack_type"), "b": F.lit(None).cast("string")}).collect()
    assert {r.value: r.n for r in rows if r.dimension == "b"} == {None: 3000}


def test_stratified_split_deals_no_rows_by_class(spark):
    """A table above the broadcast limit: its cuts are still known to be small, so the hot class is not one task's."""
    df = table(spark, 200_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200000")
    try:
        plan = split_stratified(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(attack_type" not in plan
