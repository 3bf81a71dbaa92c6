"""Boosting with patience: the stopping rule, probabilities, the model against a plain sum of its trees, node tables."""

import math

import pytest
from pyspark.sql import functions as F

from logsieve.operators import boosting, learning
from logsieve.operators.boosting import boost_binary, boost_multiclass, class_chances, stop_at
from logsieve.operators.sampling import split_three
from logsieve.sources import artifacts

FEATURES = ["x", "y"]
SMALL = {"maxIter": 6, "stepSize": 0.5, "maxDepth": 3, "minInstancesPerNode": 1, "subsamplingRate": 1.0}


@pytest.fixture(scope="module")
def table(spark):
    attack = F.when(F.col("x") + F.col("y") > 8, "scan").when(F.col("x") > 4, "inject").otherwise("normal")
    df = spark.range(1500).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y")
    )
    df = df.withColumn("attack_type", attack).withColumn("is_attack", (attack != "normal").cast("int"))
    return split_three(df).cache()


@pytest.fixture(scope="module")
def multi(table):
    return boost_multiclass(table, FEATURES, patience=3, block=4, **SMALL)


def test_waits_while_the_loss_rises_and_falls_again():
    rises = [0.5, *[0.6 + i / 100 for i in range(20)], 0.4, *[0.7] * 60]
    assert stop_at(rises, 50) == (22, 72, True)
    assert stop_at(rises, 20) == (1, 21, True)
    assert stop_at(rises, 21) == (22, 43, True)
    assert stop_at([3.0, 2.0, 2.0, 1.0], 5) == (4, 4, False)
    assert stop_at([2.0, 2.0], 1) == (1, 2, True)
    assert stop_at([], 5) == (0, 0, False)


def test_boosting_goes_past_a_rise(spark, table, monkeypatch):
    """A loss that rises for 20 rounds and falls again: the model keeps the rounds up to the fall."""
    real = boosting._valid_losses
    served = iter([0.5, *[0.9] * 20, *[0.1], *[0.9] * 40])
    monkeypatch.setattr(boosting, "_valid_losses", lambda rows, n: [next(served) for _ in real(rows, n)])
    monkeypatch.setattr(boosting, "_grow", _one_tree(boosting._grow))
    settings = {**SMALL, "maxIter": 60, "maxDepth": 1}
    found = boost_binary(table, FEATURES, settings, patience=25, block=24)
    assert learning.tree_stage(found.trained).getNumTrees == 22
    rounds = found.rounds.orderBy("round").collect()
    assert len(rounds) == 47 and sum(r.kept for r in rounds) == 22 and rounds[-1].block == 2


def _one_tree(grow):
    """The first tree for every round: what is tested is when boosting ends."""
    made = []

    def grown(*args):
        if not made:
            made.extend(grow(*args))
        return list(made)

    return grown


def test_binary_learns_and_blocks_do_not_matter(spark, table, tmp_path):
    found = boost_binary(table, FEATURES, {**SMALL, "weight": "sqrt"}, patience=3, block=4)
    again = boost_binary(table, FEATURES, {**SMALL, "weight": "sqrt"}, patience=3, block=1)
    losses = [r.valid_loss for r in found.rounds.orderBy("round").collect()]
    assert losses == pytest.approx([r.valid_loss for r in again.rounds.orderBy("round").collect()])
    assert losses == sorted(losses, reverse=True)
    test = table.filter("split = 'test'")
    assert learning.evaluate(learning.score_binary(found.trained, test)).first().f1 == 1.0
    # the stored model's probability is the one the loss was taken of
    valid = learning.score_binary(found.trained, table.filter("split = 'valid'")).collect()
    loss = sum(-math.log(r.score if r.is_attack else 1 - r.score) for r in valid) / len(valid)
    assert loss == pytest.approx(losses[-1])
    artifacts.save_model(spark, found.trained, str(tmp_path / "m"))
    loaded = artifacts.load_model(spark, str(tmp_path / "m"))
    scores = {r.row_id: r.score for r in learning.score_binary(loaded, test).collect()}
    assert scores == {r.row_id: r.score for r in learning.score_binary(found.trained, test).collect()}


def test_multiclass_probabilities(table, multi):
    test = class_chances(multi.trained, table.filter("split = 'test'")).collect()
    assert all(r.predicted_type == r.attack_type for r in test)
    assert all(sum(r.chances) == pytest.approx(1) and min(r.chances) > 0 for r in test)
    valid = class_chances(multi.trained, table.filter("split = 'valid'")).collect()
    names = ["inject", "normal", "scan"]
    loss = sum(-math.log(r.chances[names.index(r.attack_type)]) for r in valid) / len(valid)
    assert loss == pytest.approx(min(r.valid_loss for r in multi.rounds.collect()))


def log_loss(trained, rows):
    names = ["inject", "normal", "scan"]
    scored = class_chances(trained, rows).collect()
    return sum(-math.log(max(1e-15, r.chances[names.index(r.attack_type)])) for r in scored) / len(scored)


def test_multiclass_loss_is_below_the_forests(table, multi):
    test = table.filter("split = 'test'")
    forest = learning.train_multiclass(table, FEATURES, num_trees=18, max_depth=3)
    assert log_loss(multi.trained, test) < log_loss(forest, test)


def test_multiclass_of_two_classes_and_of_one(table):
    two = table.filter("attack_type <> 'scan'")
    found = boost_multiclass(two, FEATURES, patience=3, **SMALL)
    rows = class_chances(found.trained, two).collect()
    assert all(r.predicted_type == r.attack_type and sum(r.chances) == pytest.approx(1) for r in rows)
    with pytest.raises(ValueError, match="two classes"):
        boost_multiclass(table.filter("attack_type = 'scan'"), FEATURES, **SMALL)
    with pytest.raises(ValueError, match="valid"):
        boost_binary(table.filter("split <> 'valid'"), FEATURES, SMALL)


def test_chances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 800.0],), ([0.0, 0.0, 0.0],)], "m array<double>")
    rows = [r.c for r in df.select(boosting.chances(F.col("m"), 3).alias("c")).collect()]
    assert rows[0] == [0.0, 0.0, 1.0] and rows[1] == pytest.approx([1 / 3] * 3)


def test_split_counts_are_those_of_the_trees(spark, multi, tmp_path):
    path = str(tmp_path / "m")
    artifacts.save_model(spark, multi.trained, path)
    nodes = artifacts.node_table(spark, path)
    rows = nodes.collect()
    ensembles = [s for s in multi.trained.model.stages if hasattr(s, "treeWeights")]
    trees = [(k, i, t) for k, s in enumerate(ensembles) for i, t in enumerate(s.trees)]
    assert len(rows) == sum(t.numNodes for *_, t in trees)
    for k, i, tree in trees:
        own = [r for r in rows if (r.output, r.tree) == (k, i)]
        assert max(r.depth for r in own) == tree.depth and [r.node for r in own if r.depth == 0] == [0]
    counts = {r.feature: r for r in learning.importance_splits(nodes, [*FEATURES, "unused"]).collect()}
    text = "".join(t.toDebugString for *_, t in trees)
    for i, name in enumerate(FEATURES):
        assert counts[name].splits == text.count(f"If (feature {i} ")
    assert (counts["unused"].splits, counts["unused"].gain) == (0, 0.0)
    assert sum(c.splits for c in counts.values()) == sum(r.feature is None for r in rows) - len(trees)


def test_two_classes_refuse_train_rows_with_gaps(table):
    """As the library's trees do; a gap in a validation row is none of their business."""
    gap = table.withColumn("x", F.when(~((F.col("split") == "train") & (F.col("row_id") < 9)), F.col("x")))
    with pytest.raises(Exception, match="NaN"):
        boost_binary(gap, FEATURES, {**SMALL, "maxIter": 1})
    gap = table.withColumn("x", F.when(~((F.col("split") == "valid") & (F.col("row_id") < 99)), F.col("x")))
    assert boost_binary(gap, FEATURES, {**SMALL, "maxIter": 1}).rounds.count() == 1
