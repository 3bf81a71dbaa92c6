"""Sinks and read-back of tables, reports and models."""

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.operators.learning import Trained

FEATURE_LIST = "features.json"


def write_csv_report(report: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; ``files=1`` for reports of a few rows that people open by hand."""
    out = report.coalesce(files) if files else report
    out.write.mode("overwrite").option("header", True).csv(path)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header row expected; a byte-order mark at the start is dropped by the reader."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json_report(report: DataFrame, path: str, files: int | None = None) -> None:
    out = report.coalesce(files) if files else report
    out.write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", False)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_document(spark: SparkSession, document: Mapping[str, Any] | Sequence[Any], path: str) -> None:
    """A small document (feature list, class map) as one text file on the shared file system."""
    line = json.dumps(document, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.option("wholetext", True).text(path).filter(F.length("value") > 0).first()[0])


def save_model(spark: SparkSession, trained: Trained, path: str) -> None:
    """The fitted pipeline and, next to it, the feature list it was fitted on."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    write_json_document(spark, trained.features, f"{path}/{FEATURE_LIST}")


def load_model(spark: SparkSession, path: str) -> Trained:
    return Trained(PipelineModel.load(f"{path}/pipeline"), read_json_document(spark, f"{path}/{FEATURE_LIST}"))


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The trees of a saved model, one row per node.

    ``output`` numbers the model's ensembles (one margin or class each), ``tree`` and ``node`` count from 0, ``depth`` is 0
    at the root; leaves have no ``feature``, ``threshold`` and ``gain``.
    """
    trained = load_model(spark, path)
    stages = trained.model.stages
    ensembles = [(i, s) for i, s in enumerate(stages) if hasattr(s, "treeWeights")]
    if not ensembles:
        raise ValueError(f"no trees in {path}")
    digits = len(str(len(stages)))
    parts = [
        spark.read.parquet(f"{path}/pipeline/stages/{i:0{digits}d}_{s.uid}/data").select(
            F.lit(k).alias("output"), F.col("treeID").alias("tree"), "nodeData.*"
        )
        for k, (i, s) in enumerate(ensembles)
    ]
    nodes = reduce(DataFrame.unionByName, parts)
    key = ["output", "tree"]
    inner = F.col("leftChild") >= 0
    parents = nodes.filter(inner).select(
        *key, F.col("id").alias("parent"), F.explode(F.array("leftChild", "rightChild")).alias("at")
    )
    # every node climbs one level a turn until it has no parent
    found = nodes.withColumn("at", F.col("id")).withColumn("depth", F.lit(0))
    for _ in range(max(tree.depth for _, s in ensembles for tree in s.trees)):
        found = found.join(parents, [*key, "at"], "left")
        found = found.withColumn("depth", F.col("depth") + F.col("parent").isNotNull().cast("int"))
        found = found.withColumn("at", F.coalesce("parent", F.lit(-1))).drop("parent")
    names = F.array(*map(F.lit, trained.features))
    return found.select(
        *key,
        F.col("id").alias("node"),
        "depth",
        F.when(inner, names[F.col("split.featureIndex")]).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.col("rawCount").alias("rows"),
        F.col("prediction"),
    )


def class_map(indexed: DataFrame) -> dict[str, Any]:
    """Class list and numbers of a label index (one row per class)."""
    rows = indexed.orderBy("label_index").select("class", "label_index").collect()
    return {"classes": [r[0] for r in rows], "mapping": {r[0]: r[1] for r in rows}}
