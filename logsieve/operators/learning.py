"""Weights, label encoding, distributed training, search and scoring with ``pyspark.ml``."""

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions import fixed_values as V
from logsieve.operators.distribution import auc
from logsieve.operators.histogram_trees import Rounds, Tree, cut_points, ensemble, gradient, grow_told, growth, library_tree, packed, signs
from logsieve.operators.metrics import best_threshold_f1, binary_metrics, confusion, threshold_sweep
from logsieve.operators.reports import ratio
from logsieve.session import work_dir
from logsieve.sources.tables import stored

#: Share of the validation error that a round has to gain; the library's own default is ten times as much.
LEAST_GAIN = 0.001
#: An error below counts as this much in that share, as in the library.
LEAST_ERROR = 0.01
#: Deeper trees are left to the library: nodes are kept in arrays with a place for each possible one.
MOST_DEPTH = 14
#: Tree settings with a Spark counterpart. Leaf-count limits and L1/L2 terms have none; depth, minimum rows per
#: leaf and minimum gain take their place.
BINARY_CONFIGS: dict[str, dict[str, Any]] = {
    "base": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 50, "subsamplingRate": 0.8,
             "featureSubsetStrategy": "0.8", "weight": "none"},
    "weighted": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 50, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8", "weight": "full"},
    "regular": {"maxIter": 1000, "stepSize": 0.02, "maxDepth": 6, "minInstancesPerNode": 100, "minInfoGain": 0.0001,
                "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7", "weight": "sqrt"},
}
SEARCH_CONFIGS: dict[str, dict[str, Any]] = {
    "A_v3_baseline": BINARY_CONFIGS["regular"],
    "B_relaxed": {"maxIter": 2000, "stepSize": 0.01, "maxDepth": 8, "minInstancesPerNode": 20, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "0.8", "weight": "full"},
    "C_aggressive": {"maxIter": 3000, "stepSize": 0.01, "maxDepth": 10, "minInstancesPerNode": 10,
                     "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9", "weight": "full"},
}


def binary_weight(df: DataFrame, label: str = "is_attack") -> DataFrame:
    """Class balance and the two positive weights."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("positives"),
        neg.alias("negatives"),
        F.round(ratio(neg, pos), 6).alias("full_weight"),
        F.round(F.sqrt(ratio(neg, pos)), 6).alias("sqrt_weight"),
    )


def multiclass_weights(df: DataFrame, label: str = "attack_type") -> DataFrame:
    """sqrt(total / (classes x count)) per class, scaled to mean 1."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    every = W.partitionBy()  # one row per class
    classes = F.count("*").over(every)
    raw = counts.withColumn(
        "_raw", F.sqrt(F.sum("n").over(every).cast("double") / (classes * F.col("n")).cast("double"))
    )
    return raw.select("class", "n", F.round(F.col("_raw") / F.sum("_raw").over(every) * classes, 6).alias("weight"))


def label_index(df: DataFrame, label: str = "attack_type") -> DataFrame:
    """Alphabetical class numbers from 0, as the model's label encoder gives them."""
    classes = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return classes.select("class", (F.row_number().over(W.orderBy("class")) - 1).alias("label_index"), "n")


def weight_column(df: DataFrame, kind: str, label: str = "is_attack") -> Column:
    """Row weight: 1, or for positives negatives/positives (``full``) or its root (``sqrt``)."""
    if kind == "none":
        return F.lit(1.0)
    if kind not in ("full", "sqrt"):
        raise ValueError(f"unknown weight {kind!r}")
    weight = binary_weight(df, label).select(f"{kind}_weight").scalar()
    return F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0))


class Trained(NamedTuple):
    model: PipelineModel
    features: list[str]


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_binary(
    table: DataFrame,
    features: Sequence[str],
    config: str | Mapping[str, Any] = "regular",
    early_stop: bool = True,
    **override: Any,
) -> Trained:
    """Boosted trees on the train rows of ``table`` (columns ``split``, ``is_attack``).

    With ``early_stop`` the rows of split ``valid`` decide when to stop; the test rows are never looked at. Boosting goes
    on until a round lowers their error by less than LEAST_GAIN of it; the library looks at one round at a time.
    """
    settings = {**(BINARY_CONFIGS[config] if isinstance(config, str) else config), **override}
    kind = settings.pop("weight", "none")
    if early_stop:
        settings["validationIndicatorCol"] = "is_valid"
        settings.setdefault("validationTol", LEAST_GAIN)
    fitted = table.filter(F.col("split").isin("train", "valid"))
    weighted = fitted.select(
        *features,
        F.col("is_attack").cast("double").alias("label"),
        weight_column(fitted.filter(F.col("split") == "train"), kind).alias("weight"),
        (F.col("split") == "valid").alias("is_valid"),
    )
    trees = GBTClassifier(
        labelCol="label",
        featuresCol="features",
        weightCol="weight",
        seed=42,
        cacheNodeIds=False,
        checkpointInterval=10,
        **settings,
    )
    return Trained(PipelineModel([_assembler(features), _boosted(trees, _assembler(features).transform(weighted))]), list(features))


def rounds_kept(errors: Sequence[float], tolerance: float) -> tuple[int, bool]:
    """The library's rule: how many rounds are kept, and whether boosting ends, after the validation errors of all rounds so far."""
    kept = 1
    for i, error in enumerate(errors[1:], 2):
        best = errors[kept - 1]
        if best - error < tolerance * max(error, LEAST_ERROR):
            return kept, True
        if error < best:
            kept = i
    return kept, False


def sound(rows: DataFrame, *unseen: Column) -> DataFrame:
    """``rows`` as the library takes them: labels 0 and 1, weights from 0, numbers as features. Others fail, but for the ``unseen``."""
    number = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") >= 0) & (F.col("weight") < float("inf"))
    finite = F.forall(vector_to_array("features"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    faults = [
        (~F.coalesce(F.col("label").isin(0.0, 1.0), F.lit(False)), "labels must be 0 or 1"),
        (~F.coalesce(number, F.lit(False)), "weights must be numbers from 0"),
        (~F.coalesce(finite, F.lit(False)), "features must not be NaN or infinite"),
    ]
    checked = F.col("label")
    for wrong, message in faults:
        for some in unseen:
            wrong &= ~some
        checked = F.when(wrong, F.raise_error(F.lit(message)).cast("double")).otherwise(checked)
    return rows.withColumn("label", checked.cast("int"))


def _boosted(settings: GBTClassifier, rows: DataFrame) -> GBTClassificationModel:
    """The model that the library's classifier of these settings describes, its trees grown from sums by bin over packed rows.

    Losses, residuals, weights of the trees, samples, features drawn and early stopping are the library's rules; cut points are
    taken of all train rows. Trees with a least share of the weight in a leaf, very deep ones and those of many bins stay with the library.
    """
    if settings.getMinWeightFractionPerNode() > 0 or settings.getMaxDepth() > MOST_DEPTH or settings.getMaxBins() > 256:
        return settings.fit(rows)
    spark, validates = rows.sparkSession, settings.hasParam("validationIndicatorCol") and settings.isSet("validationIndicatorCol")
    kept = rows.select("features", "label", "weight", F.col("is_valid") if validates else F.lit(False).alias("is_valid"))
    cuts = cut_points(sound(kept), settings.getMaxBins())
    strategy = settings.getFeatureSubsetStrategy()
    named = {
        "maxDepth": settings.getMaxDepth(), "minInstancesPerNode": settings.getMinInstancesPerNode(), "minInfoGain": settings.getMinInfoGain(),
        "subsamplingRate": settings.getSubsamplingRate(), "featureSubsetStrategy": strategy, "maxBins": settings.getMaxBins(),
    }
    grown_by, sizes, seed = growth(len(cuts), named), [len(c) for c in cuts], settings.getSeed()
    rounds = Rounds(packed(sound(kept), cuts, 1), len(cuts), gradient)
    trees: list[Tree] = []
    errors: list[float] = []

    def ended(loss: float, weight: float) -> bool:
        if validates:
            if not weight > 0:
                raise ValueError("early stopping needs rows of split 'valid'")
            errors.append(loss / weight)
        return validates and rounds_kept(errors, settings.getValidationTol())[1]

    for m in range(settings.getMaxIter()):
        grown, told = grow_told(rounds.rows, sizes, 1, seed + m, grown_by, gradient if m else signs)
        if m and ended(*told):
            break  # told by the pass for the next tree, which is not used
        trees += grown
        rounds.advance(grown, settings.getStepSize() if m else 1.0)
    else:
        losses, weight, _ = rounds.losses()
        ended(losses[-1], weight)
    rounds.close()
    if validates:
        trees = trees[: rounds_kept(errors, settings.getValidationTol())[0]]
    made = [library_tree(spark, tree, cuts) for tree in trees]
    weights = [1.0] + [settings.getStepSize()] * (len(made) - 1)
    model = ensemble(GBTClassificationModel, "org.apache.spark.ml.classification.GBTClassificationModel", made, weights, 2)
    return settings._copyValues(model)


def train_multiclass(
    table: DataFrame,
    features: Sequence[str],
    learner: str = "forest",
    num_trees: int = 100,
    max_depth: int = 6,
    **override: Any,
) -> Trained:
    """Attack-class model on the train rows; classes numbered alphabetically and weighted by root frequency.

    ``forest`` is natively multiclass and gives probabilities; ``boosted`` is one boosted model per class.
    """
    train = table.filter(F.col("split") == "train")
    # one row per class, as a table whose size is known: rows are not dealt by class
    weights = multiclass_weights(train).select(F.col("class").alias("attack_type"), "weight")
    weights = stored(weights, work_dir(table.sparkSession))
    weighted = train.select(*features, "attack_type").join(weights, "attack_type")
    indexer = StringIndexer(inputCol="attack_type", outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    if learner == "forest":
        model = RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=num_trees, maxDepth=max_depth, seed=42, **override
        )
    elif learner == "boosted":
        trees = GBTClassifier(maxIter=num_trees, maxDepth=max_depth, seed=42, **override)
        model = OneVsRest(classifier=trees, labelCol="label", weightCol="weight", parallelism=2)
    else:
        raise ValueError(f"unknown learner {learner!r}")
    fitted = Pipeline(stages=[_assembler(features), model]).fit(indexer.transform(weighted))
    back = IndexToString(inputCol="prediction", outputCol="predicted_type", labels=indexer.labels)
    return Trained(PipelineModel([*fitted.stages, back]), list(features))


def score_binary(trained: Trained, table: DataFrame, threshold: float = V.DEFAULT_THRESHOLD) -> DataFrame:
    """Attack probability and the decision at ``threshold``."""
    scored = trained.model.transform(table)
    return scored.select(
        *table.columns, vector_to_array("probability")[1].alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_multiclass(trained: Trained, table: DataFrame) -> DataFrame:
    return trained.model.transform(table).select(*table.columns, "predicted_type")


def tree_stage(trained: Trained) -> Transformer:
    return next(s for s in trained.model.stages if hasattr(s, "featureImportances"))


def feature_importance(trained: Trained, table: DataFrame) -> DataFrame:
    """Gain-based importance per feature, highest first; the model holds one number per feature."""
    values = tree_stage(trained).featureImportances.toArray().tolist()
    rows = list(zip(trained.features, values, strict=True))
    frame = table.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def importance_splits(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """How often the trees of a node table split on each feature, most first, with the gain of these splits.

    Features without a split have 0. The counts add up to the inner nodes: per tree, one less than its leaves.
    """
    used = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(
        F.count("*").alias("splits"), F.sum("gain").alias("gain"), F.min("depth").alias("first_depth")
    )
    listed = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    counted = listed.join(used, "feature", "left").fillna({"splits": 0, "gain": 0.0})
    return counted.orderBy(F.desc("splits"), "feature")


def evaluate(scored: DataFrame) -> DataFrame:
    """Counts, rates and AUC of scored rows, one row."""
    area = auc(scored).select("auc").scalar()
    return binary_metrics(confusion(scored)).withColumn("auc", F.round(area, 4))


def search(
    table: DataFrame,
    features: Sequence[str],
    configs: Mapping[str, Mapping[str, Any]] = SEARCH_CONFIGS,
    **override: Any,
) -> tuple[DataFrame, dict[str, Trained]]:
    """Train each configuration, choose its threshold and rank it by the ``valid`` rows, and report on the ``test`` rows."""
    valid, test = (table.filter(F.col("split") == part) for part in ("valid", "test"))

    def tried(settings: Mapping[str, Any]) -> tuple[Trained, DataFrame]:
        trained = train_binary(table, features, {**settings, **override})
        sweep = threshold_sweep(score_binary(trained, valid), V.SWEEP_GRIDS["search"])
        best = best_threshold_f1(sweep).select("threshold", "f1").first()
        chosen = [F.lit(best["threshold"]).alias("best_threshold"), F.lit(best["f1"]).alias("best_f1")]
        return trained, evaluate(score_binary(trained, test, best["threshold"])).select("*", *chosen)

    # a round of boosting is many short jobs, so configurations are trained side by side
    with ThreadPoolExecutor(len(configs)) as pool:
        found = dict(zip(configs, pool.map(tried, configs.values()), strict=True))
    models = {name: trained for name, (trained, _) in found.items()}
    reports = [report.select(F.lit(name).alias("config"), "*") for name, (_, report) in found.items()]
    ranked = reports[0]
    for report in reports[1:]:
        ranked = ranked.unionByName(report)
    return ranked.orderBy(F.desc("best_f1"), "config"), models
