"""Reproducible samples and splits. All randomness is an md5 of the row id, so results never depend on layout."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.functions.hashing import md5_key, md5_number
from logsieve.operators.coverage import label_text
from logsieve.session import checkpoint, work_dir
from logsieve.sources.tables import stored

BUCKET_DIGITS = 4  # hex digits of the md5 key: 65,536 histogram buckets


def sample_n(df: DataFrame, n: int, seed: str = "42", key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (all when fewer). Top-n per task, then one merge of at most n rows per task."""
    return df.orderBy(md5_key(seed, key), key).limit(n)


def balanced_sample(df: DataFrame, n_attack: int, n_normal: int, seed: str = "42") -> DataFrame:
    """``n_attack`` attacks and ``n_normal`` normal requests with a text label."""
    rank = F.row_number().over(W.partitionBy("is_attack").orderBy(md5_key(seed, "row_id"), "row_id"))
    # The first filter is a group limit inside the tasks, so one scan serves both classes.
    first = df.withColumn("_rank", rank).filter(F.col("_rank") <= max(n_attack, n_normal))
    wanted = F.when(F.col("is_attack") == 1, n_attack).when(F.col("is_attack") == 0, n_normal).otherwise(0)
    return first.filter(F.col("_rank") <= wanted).drop("_rank").withColumn("label", label_text(F.col("is_attack")))


def split_label(seed: str = "split", key: str = "row_id", train_percent: int = 80) -> Column:
    return F.when(md5_number(seed, key) % 100 < train_percent, "train").otherwise("test")


def split_random(df: DataFrame, train_percent: int = 80, seed: str = "split", key: str = "row_id") -> DataFrame:
    """Row-wise split; the part is a column, so text columns stay with their features. No shuffle."""
    return df.withColumn("split", split_label(seed, key, train_percent))


def split_three(df: DataFrame, train_percent: int = 80, valid_percent: int = 10, seed: str = "split") -> DataFrame:
    """Train, valid, test, so that early stopping never looks at the test part."""
    slot = md5_number(seed, "row_id") % 100
    return df.withColumn(
        "split",
        F.when(slot < train_percent - valid_percent, "train").when(slot < train_percent, "valid").otherwise("test"),
    )


def _stratum_cuts(df: DataFrame, label: str, train_percent: int, seed: str, key: str) -> DataFrame:
    """Per class the hash key of its last training row: ``(label, _cut_hash, _cut_key)``.

    Labels and hashes are computed once and checkpointed. A histogram of hash prefixes finds the bucket the cut falls in; only that bucket's rows (1/65,536 of a class)
    are ranked. Sorting a whole class would put the largest class into one task.
    """
    digits = F.substring("_hash", 1, BUCKET_DIGITS)
    keyed = checkpoint(df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), md5_key(seed, key).alias("_hash")))
    counts = keyed.groupBy("_label", digits.alias("_bucket")).agg(F.count("*").alias("_n"))
    whole = W.partitionBy("_label")
    upto = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    want = F.expr(f"_total * {int(train_percent)} DIV 100")
    edge = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_want", want)
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select("_label", "_bucket", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    inside = keyed.withColumn("_bucket", digits).join(edge, ["_label", "_bucket"])
    rank = F.row_number().over(W.partitionBy("_label").orderBy("_hash", "_key"))
    return (
        inside.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(F.col("_label").alias(label), F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key"))
    )


def split_stratified(
    df: DataFrame, label: str = "attack_type", train_percent: int = 80, seed: str = "split", key: str = "row_id"
) -> DataFrame:
    """Exact share of every class: floor(share x class size) rows of smallest hash go to train.

    There is one cut per class. They are a table of their own, whose size is known when the join is planned: few classes are
    broadcast and rows are not shuffled, and a hot one of many classes can be split. Straight out of the ranking, the cuts
    would have their rows joined where a class was ranked, each class in one task.
    """
    cuts = stored(_stratum_cuts(df, label, train_percent, seed, key), work_dir(df.sparkSession))
    joined = df.withColumn("_hash", md5_key(seed, key)).join(cuts, label, "left")
    below = (F.col("_hash") < F.col("_cut_hash")) | (
        (F.col("_hash") == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key"))
    )
    return joined.withColumn("split", F.when(F.coalesce(below, F.lit(False)), "train").otherwise("test")).drop(
        "_hash", "_cut_hash", "_cut_key"
    )
