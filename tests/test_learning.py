import pytest
from pyspark.sql import functions as F

from logsieve.operators import learning
from logsieve.operators.sampling import split_three
from logsieve.sources import artifacts
from logsieve.sources.tables import read_table, write_table

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(1200).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 5).cast("double").alias("y"),
        (F.col("id") % 7 > 4).cast("int").alias("is_attack"),
        F.when(F.col("id") % 7 > 5, "scan").when(F.col("id") % 7 > 4, "inject").otherwise("normal").alias("attack_type"),
    )
    return split_three(df).cache()


@pytest.fixture(scope="module")
def trained(table):
    return learning.train_binary(table, FEATURES, maxIter=3, maxDepth=3, stepSize=0.3)


def test_weights(spark):
    df = spark.createDataFrame([("a", 1)] * 4 + [("b", 0)] * 16, "attack_type string, is_attack int")
    row = learning.binary_weight(df).first()
    assert (row.full_weight, row.sqrt_weight) == (4.0, 2.0)
    weights = {r["class"]: r.weight for r in learning.multiclass_weights(df).collect()}
    assert weights == {"a": pytest.approx(4 / 3, abs=1e-6), "b": pytest.approx(2 / 3, abs=1e-6)}
    index = artifacts.class_map(learning.label_index(df))
    assert index == {"classes": ["a", "b"], "mapping": {"a": 0, "b": 1}}


def test_binary_learns_saves_and_loads(spark, table, trained, tmp_path):
    test = table.filter("split = 'test'")
    row = learning.evaluate(learning.score_binary(trained, test)).first()
    assert row.f1 == 1.0 and row.auc == 1.0
    artifacts.save_model(spark, trained, str(tmp_path / "m"))
    loaded = artifacts.load_model(spark, str(tmp_path / "m"))
    assert loaded.features == FEATURES
    before = {r.row_id: r.score for r in learning.score_binary(trained, test).collect()}
    after = {r.row_id: r.score for r in learning.score_binary(loaded, test).collect()}
    assert before == after
    importance = learning.feature_importance(trained, table).collect()
    assert importance[0].feature == "x"


def test_walked_trees_are_those_of_kept_nodes(table, trained, monkeypatch):
    """Training keeps no node of every row and grows the same trees."""
    real = learning.GBTClassifier
    monkeypatch.setattr(learning, "GBTClassifier", lambda **k: real(**{**k, "cacheNodeIds": True}))
    walked, kept = (learning.tree_stage(t) for t in (trained, learning.train_binary(table, FEATURES, maxIter=3, maxDepth=3, stepSize=0.3)))
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    below = lambda model: [tree.toDebugString.split("\n")[1:] for tree in model.trees]
    assert below(walked) == below(kept)


def test_boosting_goes_on_while_the_error_falls(table):
    """The library's own tolerance gives up after a few rounds of such small steps."""
    settings = {"maxIter": 30, "maxDepth": 2, "minInstancesPerNode": 1}
    patient = learning.train_binary(table, FEATURES, "regular", **settings)
    assert learning.tree_stage(patient).getNumTrees == 30


@pytest.mark.parametrize("learner", ["forest", "boosted"])
def test_multiclass(table, learner):
    model = learning.train_multiclass(table, FEATURES, learner, num_trees=3, max_depth=4)
    predicted = learning.score_multiclass(model, table.filter("split = 'test'"))
    assert predicted.filter("attack_type <> predicted_type").count() == 0


def test_search_ranks_by_best_f1(table):
    configs = {"weak": {"maxDepth": 1, "maxIter": 1, "weight": "none"}, "good": {"maxDepth": 3, "maxIter": 2, "weight": "sqrt"}}
    ranked, models = learning.search(table, FEATURES, configs)
    assert set(models) == set(configs) and ranked.count() == 2
    assert ranked.first().best_f1 == 1.0


def test_reports_and_tables(spark, table, tmp_path):
    report = spark.createDataFrame([("a", 0.5), ("ü", None)], "name string, rate double")
    artifacts.write_csv_report(report, str(tmp_path / "csv"), files=1)
    artifacts.write_json_report(report, str(tmp_path / "json"))
    assert set(artifacts.read_csv_report(spark, str(tmp_path / "csv"), report.schema.simpleString()[7:-1].replace(":", " ")).collect()) == set(
        report.collect()
    )
    assert set(artifacts.read_json_report(spark, str(tmp_path / "json"), "name string, rate double").collect()) == set(report.collect())
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfname,rate\na,0.5\n")
    assert artifacts.read_csv_report(spark, str(tmp_path / "bom.csv"), "name string, rate double").first().name == "a"
    artifacts.write_json_document(spark, {"ü": [1]}, str(tmp_path / "doc"))
    assert artifacts.read_json_document(spark, str(tmp_path / "doc")) == {"ü": [1]}
    write_table(table, str(tmp_path / "t"), ["attack_type"])
    assert read_table(spark, str(tmp_path / "t"), ["x", "attack_type"]).filter("attack_type = 'scan'").count() == 171


def test_packed_rows_give_the_librarys_trees(spark, monkeypatch):
    """Without samples, draws and ties the model is that of the library, its early stopping included, in fewer jobs."""
    tracker = spark.sparkContext.statusTracker()
    noise = (F.hash("row_id") % 10 == 0).cast("int")
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.pmod(F.hash("id", F.lit(1)), F.lit(7)).cast("double").alias("x"), F.pmod(F.hash("id", F.lit(2)), F.lit(5)).cast("double").alias("y")
    )
    df = split_three(df.withColumn("is_attack", ((F.col("x") * 3 + F.col("y") * F.col("y") > 15).cast("int") + noise) % 2)).cache()
    df.count()
    settings = {"maxIter": 40, "maxDepth": 3, "minInstancesPerNode": 5, "stepSize": 0.3, "weight": "sqrt"}
    jobs, models = [], []
    for packs in (True, False):
        if not packs:
            monkeypatch.setattr(learning, "_boosted", lambda estimator, rows: estimator.fit(rows))
        before = max(tracker.getJobIdsForGroup())
        models.append(learning.train_binary(df, FEATURES, settings))
        jobs.append(max(tracker.getJobIdsForGroup()) - before)
    ours, library = (learning.tree_stage(m) for m in models)
    assert 1 < ours.getNumTrees == library.getNumTrees < 40 and ours.treeWeights == pytest.approx(library.treeWeights)
    scores = [{r.row_id: r.score for r in learning.score_binary(m, df).collect()} for m in models]
    assert scores[0] == pytest.approx(scores[1])
    assert ours.featureImportances.toArray().tolist() == pytest.approx(library.featureImportances.toArray().tolist())
    assert jobs[0] < jobs[1]


def test_the_librarys_stopping_rule():
    assert learning.rounds_kept([0.5], 0.001) == (1, False)
    assert learning.rounds_kept([0.5, 0.4, 0.3999], 0.001) == (2, True)
    assert learning.rounds_kept([0.5, 0.6], 0.001) == (1, True)
    assert learning.rounds_kept([0.005, 0.00498, 0.00497], 0.0015) == (2, True)


def test_rows_the_library_refuses(table):
    empty = table.withColumn("x", F.when(F.col("row_id") > 5, F.col("x")))
    with pytest.raises(Exception, match="NaN"):
        learning.train_binary(empty, FEATURES, maxIter=1, maxDepth=1)
