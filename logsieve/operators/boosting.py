"""Boosted trees with patience, for two or more classes, as ensembles of Spark's regression trees.

A round fits one tree per margin on the Newton step of the log loss: residual over curvature, weighted by the curvature.
Two classes need one margin, more classes one for each (softmax); the trees of a round are grown together, one pass over packed
rows a level. Margins go on from round to round with the rows.
"""

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark import RDD
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import IndexToString, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.operators.histogram_trees import Rounds, Tree, cut_points, ensemble, grow, growth, library_tree, packed
from logsieve.operators.learning import BINARY_CONFIGS, Trained, multiclass_weights, sound, weight_column

#: Rounds without a lower validation loss after which boosting ends.
PATIENCE = 50
#: Rounds between two looks at the validation loss.
BLOCK = 5
#: Multiclass settings; as for two classes, leaf-count limits and L1/L2 terms have no counterpart.
MULTICLASS_CONFIG: dict[str, Any] = {
    "maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 20, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
}


class Boosted(NamedTuple):
    trained: Trained
    #: One row per round: round (from 1), block, valid_loss, kept (1 for the rounds of the model).
    rounds: DataFrame


class Stop(NamedTuple):
    #: Number of rounds up to the lowest loss, and up to the end of waiting.
    best: int
    seen: int
    ended: bool


def stop_at(losses: Sequence[float], patience: int) -> Stop:
    """The round of the lowest loss, waiting ``patience`` rounds for a lower one; of equal ones the first."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return Stop(best + 1, i + 1, True)
    return Stop(min(best + 1, len(losses)), len(losses), False)


def chances(margins: Column, classes: int) -> Column:
    """Class probabilities of an array of margins: one margin for two classes, else one for each."""
    if classes == 2:
        positive = 1 / (1 + F.exp(-margins[0]))
        return F.array(1 - positive, positive)
    powers = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


class _SharedTrees:
    """The trees of a round, one per margin, are grown together over packed rows."""

    def __init__(self, rows: DataFrame, outputs: int, settings: Mapping[str, Any], step: float) -> None:
        self.spark, self.outputs, self.step = rows.sparkSession, outputs, step
        self.cuts = cut_points(rows, settings.get("maxBins", 32))
        self.sizes, self.growth = [len(c) for c in self.cuts], growth(len(self.cuts), settings)
        self.rounds = Rounds(packed(rows, self.cuts, outputs), len(self.cuts))

    def grow(self, rows: RDD, seed: int) -> list[Tree]:
        return grow(rows, self.sizes, self.outputs, seed, self.growth)

    def model(self, tree: Tree) -> DecisionTreeRegressionModel:
        return library_tree(self.spark, tree, self.cuts)


def _grow(way: _SharedTrees, rows: RDD, seed: int) -> list[Any]:
    """The trees of one round over the same persisted rows."""
    return way.grow(rows, seed)


def _valid_losses(rounds: Rounds, n: int) -> list[float]:
    """Mean loss of the validation rows in the last ``n`` rounds."""
    losses, _, count = rounds.losses()
    if not count:
        raise ValueError("patience needs rows of split 'valid' whose class has training rows")
    return [loss / count for loss in losses[-n:]]


def _boost(
    rows: DataFrame, classes: int, patience: int, block: int, settings: Mapping[str, Any]
) -> tuple[list[list[DecisionTreeRegressionModel]], float, DataFrame]:
    """Trees per margin up to the best round, the step, and the table of rounds.

    ``rows``: features, label (class number), weight, is_valid.
    """
    tree = dict(settings)
    most, step = tree.pop("maxIter"), tree.pop("stepSize")
    spark = rows.sparkSession
    outputs = 1 if classes == 2 else classes
    if outputs == 1:  # two classes take what the library's trees take; for more, missing values lie above every threshold
        rows = sound(rows, F.col("is_valid"))
    way = _SharedTrees(rows, outputs, tree, step)
    trees: list[list[Any]] = []
    losses: list[float] = []
    while len(losses) < most and not stop_at(losses, patience).ended:
        n = min(block, most - len(losses))
        for i in range(n):
            trees.append(_grow(way, way.rounds.rows, len(losses) + i))
            way.rounds.advance(trees[-1], step)
        losses += _valid_losses(way.rounds, n)
    way.rounds.close()
    stop = stop_at(losses, patience)
    listed = [(i + 1, i // block + 1, loss, int(i < stop.best)) for i, loss in enumerate(losses[: stop.seen])]
    table = spark.createDataFrame(listed, "round int, block int, valid_loss double, kept int")
    return [[way.model(t[k]) for t in trees[: stop.best]] for k in range(outputs)], step, table


def _rows(table: DataFrame, assembler: VectorAssembler, label: Column, weight: Column) -> DataFrame:
    fitted = table.filter(F.col("split").isin("train", "valid"))
    return assembler.transform(fitted).select(
        "features", label.alias("label"), weight.alias("weight"), (F.col("split") == "valid").alias("is_valid")
    )


def boost_binary(
    table: DataFrame,
    features: Sequence[str],
    config: str | Mapping[str, Any] = "base",
    patience: int = PATIENCE,
    block: int = BLOCK,
    **override: Any,
) -> Boosted:
    """Attack model on the train rows of ``table`` (columns ``split``, ``is_attack``), for ``score_binary``.

    Ends when ``patience`` rounds in a row have not lowered the log loss of the ``valid`` rows, or after ``maxIter`` rounds, and
    keeps the rounds up to the lowest loss. Rows without a label count as no attack. Test rows are never looked at.
    """
    settings = {**(BINARY_CONFIGS[config] if isinstance(config, str) else config), **override}
    kind = settings.pop("weight", "none")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    label = F.coalesce(F.col("is_attack").cast("int"), F.lit(0))
    weight = weight_column(table.filter(F.col("split") == "train"), kind)
    rows = _rows(table, assembler, label, F.coalesce(weight, F.lit(1.0)))
    trees, step, rounds = _boost(rows, 2, patience, block, settings)
    # the library's probability is that of twice the margin
    weights = [step / 2] * len(trees[0])
    model = ensemble(GBTClassificationModel, "org.apache.spark.ml.classification.GBTClassificationModel", trees[0], weights, 2)
    return Boosted(Trained(PipelineModel([assembler, model]), list(features)), rounds)


def boost_multiclass(
    table: DataFrame,
    features: Sequence[str],
    config: Mapping[str, Any] = MULTICLASS_CONFIG,
    patience: int = PATIENCE,
    block: int = BLOCK,
    **override: Any,
) -> Boosted:
    """Attack-class model (column ``attack_type``) by softmax boosting, for ``score_multiclass`` and ``class_chances``.

    Classes are those of the train rows, numbered alphabetically and weighted by root frequency; valid rows of other
    classes do not count. A column ``probability`` holds chances that add up to 1. One class alone is an error.
    """
    train = table.filter(F.col("split") == "train")
    weights = multiclass_weights(train.filter("attack_type IS NOT NULL")).collect()  # one row per class
    names = sorted(w["class"] for w in weights)
    if len(names) < 2:
        raise ValueError("boosting needs two classes or more")
    by_class = {w["class"]: w["weight"] for w in weights}
    known = F.col("attack_type").isin(names)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("attack_type")).cast("int") - 1
    weight = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, by_class[n])]), F.col("attack_type"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rows = _rows(table.filter(known), assembler, label, weight)
    trees, step, rounds = _boost(rows, len(names), patience, block, {**config, **override})
    stages: list[Transformer] = [assembler]
    for k, grown in enumerate(trees):
        model = ensemble(GBTRegressionModel, "org.apache.spark.ml.regression.GBTRegressionModel", grown, [step] * len(grown))
        stages.append(model.setPredictionCol(f"margin_{k}"))
    stages += _softmax_stages(names, len(trees))
    return Boosted(Trained(PipelineModel(stages), list(features)), rounds)


def _softmax_stages(names: Sequence[str], outputs: int) -> list[Transformer]:
    """Margins to a probability vector, a class number and a class name."""
    count = len(names)
    if outputs == 1:
        powers = "array(exp(-greatest(margin_0, 0D)), exp(margin_0 - greatest(margin_0, 0D)))"
    else:
        margins = ", ".join(f"margin_{k}" for k in range(outputs))
        powers = ", ".join(f"exp(margin_{k} - greatest({margins}))" for k in range(outputs))
        powers = f"array({powers})"
    shares = ", ".join(f"powers[{k}] / aggregate(powers, 0D, (a, b) -> a + b) AS chance_{k}" for k in range(count))
    return [
        SQLTransformer(statement=f"SELECT *, {powers} AS powers FROM __THIS__"),
        SQLTransformer(
            statement=f"SELECT *, {shares}, double(array_position(powers, array_max(powers)) - 1) AS prediction FROM __THIS__"
        ),
        VectorAssembler(inputCols=[f"chance_{k}" for k in range(count)], outputCol="probability"),
        IndexToString(inputCol="prediction", outputCol="predicted_type", labels=list(names)),
    ]


def class_chances(trained: Trained, table: DataFrame) -> DataFrame:
    """``table`` with the predicted class and the array of class probabilities, classes in alphabetical order."""
    scored = trained.model.transform(table)
    return scored.select(*table.columns, "predicted_type", vector_to_array("probability").alias("chances"))
