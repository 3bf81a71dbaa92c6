"""Trees from sums by bin against brute force, as library trees, and how many jobs a round takes."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from logsieve.operators import histogram_trees as trees
from logsieve.operators.boosting import boost_multiclass
from logsieve.operators.sampling import split_three


@pytest.fixture(scope="module")
def rows():
    """Features of few values, of many, of one, without any, and with gaps; the label follows the first two."""
    rng = random.Random(3)
    found = []
    for i in range(900):
        x = [float(rng.randrange(4)), rng.random(), 7.0, math.nan, rng.choice([math.nan, 1.0, 2.0])]
        label = int(x[0] > 1) + int(x[1] > 0.6 and x[4] != 1.0)
        found.append((x, label, 1.0 + label / 2, i % 5 == 0))
    return found


@pytest.fixture(scope="module")
def packed(spark, rows):
    schema = "features array<double>, label int, weight double, is_valid boolean"
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("features")).repartition(3)
    cuts = trees.cut_points(df)
    return cuts, trees.packed(df, cuts, 3).cache()


def newton(rows, output):
    third = 1 / 3
    curvature = third * (1 - third)
    return [(x, max(-4, min(4, ((label == output) - third) / curvature)), w * curvature) for x, label, w, valid in rows if not valid]


def spread(rows):
    """Weighted squared distance from the mean."""
    w = sum(r[2] for r in rows)
    mean = sum(r[1] * r[2] for r in rows) / w
    return sum(r[2] * (r[1] - mean) ** 2 for r in rows), mean, w


def compare(tree, cuts, node, rows, depth, least):
    whole, mean, weight = spread(rows)
    assert tree.sums[node][0] == len(rows) and tree.value[node] == pytest.approx(mean)
    best = 0.0
    for f, points in enumerate(cuts):
        for cut in points if depth else ():
            low, high = [r for r in rows if r[0][f] <= cut], [r for r in rows if not r[0][f] <= cut]
            if len(low) >= least and len(high) >= least:
                best = max(best, (whole - spread(low)[0] - spread(high)[0]) / weight)
    if tree.feature[node] < 0:
        assert best < 1e-9
        return 1
    assert tree.gain[node] == pytest.approx(best)
    f, cut = tree.feature[node], cuts[tree.feature[node]][tree.cut[node]]
    low, high = [r for r in rows if r[0][f] <= cut], [r for r in rows if not r[0][f] <= cut]
    return 1 + compare(tree, cuts, 2 * node + 1, low, depth - 1, least) + compare(tree, cuts, 2 * node + 2, high, depth - 1, least)


def test_every_split_is_the_best_one(spark, rows, packed):
    cuts, state = packed
    assert [len(c) for c in cuts] == [3, 31, 0, 0, 1] and cuts[0].tolist() == [0.5, 1.5, 2.5] and cuts[4].tolist() == [1.5]
    settings = trees.growth(5, {"maxDepth": 3, "minInstancesPerNode": 20})
    grown = trees.grow(state, [len(c) for c in cuts], 3, 0, settings)
    sizes = [compare(tree, cuts, 0, newton(rows, k), 3, 20) for k, tree in enumerate(grown)]
    assert max(sizes) > 5
    model = trees.library_tree(spark, grown[0], cuts)
    values = np.array([r[0] for r in rows])
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, values.T)])
    walked = grown[0].value[trees._reached(grown[0], bins)]
    assert [model.predict(Vectors.dense(v)) for v in values] == pytest.approx(walked.tolist())
    moved = trees.advance(state, grown, 0.3, 5)
    assert moved.columns == state.columns
    blocks = moved.collect()
    assert sum(b.n_valid for b in blocks) == 180 and sum(len(b.label) // 2 for b in blocks) == 900
    assert sum(b.losses[0] for b in blocks) / 180 < math.log(3)


def test_samples_and_draws(packed):
    cuts, state = packed
    sizes = [len(c) for c in cuts]
    settings = trees.growth(5, {"maxDepth": 2, "subsamplingRate": 0.5, "featureSubsetStrategy": "0.2"})
    assert settings.features == 1
    first, again = (trees.grow(state, sizes, 3, 7, settings) for _ in range(2))
    assert all((a == b).all() for x, y in zip(first, again) for a, b in zip(x, y))
    seen = {t.sums[0][0] for t in first}
    assert len(seen) > 1 and all(280 < n < 440 for n in seen)
    for name, n in (("all", 28), ("auto", 28), ("sqrt", 6), ("log2", 5), ("onethird", 10), ("0.8", 23), ("3", 3)):
        assert trees.growth(28, {"featureSubsetStrategy": name}).features == n
    with pytest.raises(ValueError, match="settings"):
        trees.growth(28, {"numLeaves": 31})


def test_a_round_takes_as_many_jobs_for_eight_classes_as_for_three(spark):
    """One pass a level for the trees of all classes, not one for each tree."""
    tracker, used = spark.sparkContext.statusTracker(), []
    for classes in (3, 8):
        df = spark.range(1200).select(F.col("id").alias("row_id"), (F.col("id") % 24).cast("double").alias("x"))
        df = split_three(df.withColumn("attack_type", F.concat(F.lit("c"), F.col("x").cast("int") % classes))).cache()
        df.count()
        before = max(tracker.getJobIdsForGroup())
        boost_multiclass(df, ["x"], maxIter=1, stepSize=0.5, maxDepth=2, minInstancesPerNode=1, subsamplingRate=1.0)
        used.append(max(tracker.getJobIdsForGroup()) - before)
    assert abs(used[1] - used[0]) <= 3


def test_of_two_siblings_one_is_summed(packed, monkeypatch):
    """The other has what is left of its parent; the splits are the same (see above)."""
    cuts, state = packed
    real, summed = trees._level_sums, []
    monkeypatch.setattr(trees, "_level_sums", lambda t, places, *more: summed.append([int(p.max()) + 1 for p in places]) or real(t, places, *more))
    grown = trees.grow(state, [len(c) for c in cuts], 3, 0, trees.growth(5, {"maxDepth": 3, "minInstancesPerNode": 20}))
    assert summed[0] == [1, 1, 1] and summed[1] == [1, 1, 1] and all(n <= 2 for n in summed[2])
    assert all(tree.feature[0] >= 0 for tree in grown)


def test_sums_over_many_tasks_are_added_by_tasks(packed, monkeypatch):
    cuts, state = packed
    sizes, settings = [len(c) for c in cuts], trees.growth(5, {"maxDepth": 3, "minInstancesPerNode": 20})
    direct = trees.grow(state, sizes, 3, 0, settings)
    monkeypatch.setattr(trees, "DIRECT_BYTES", 0)
    dealt = trees.grow(state, sizes, 3, 0, settings)
    assert all((a == b).all() for x, y in zip(direct, dealt) for a, b in zip(x, y))


def test_bundles_hold_every_feature_once():
    sizes = [31, 1, 1, 0, 7, 1, 255]
    groups = trees.bundles(sizes, 64)
    assert sorted(f for g in groups for f in g) == list(range(7)) and len(groups) < 5
    assert all(len(g) == 1 or math.prod(sizes[f] + 1 for f in g) <= 64 for g in groups)
