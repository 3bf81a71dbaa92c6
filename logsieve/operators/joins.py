"""Attaching labels to features by row id."""

from pyspark.sql import DataFrame


def join_labels(features: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Features with ``is_attack`` and ``attack_type``; row ids are unique, so no key is hot.

    ``how='left'`` keeps feature rows without a label.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join {how!r}")
    return features.join(labels.select("row_id", "is_attack", "attack_type"), "row_id", how)


def join_colocated(features: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """The same for two tables in the same number of buckets by row id: tasks merge file with file, nothing is exchanged."""
    return join_labels(features, labels.hint("merge"), how)
