"""Exact de-duplication: group by a 128-bit content hash, compare the bytes inside groups, keep one row of each."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.work import spread_join, stored

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def without_white_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. The row with the most code points in its original
    text stays, then the one with the smallest id.

    The MD5 of the normalised text is the group's key. The same aggregation takes the smallest and the largest text of
    a group: where they are the same bytes, all are. Groups whose bytes differ (a hash collision) are grouped again by
    the bytes themselves; where there are none, as nearly always, that step is not run. The aggregation combines inside the map tasks, so a group that holds a third of all rows
    reaches the shuffle as one row per task, and its members get their verdict from a join that adaptive execution can
    split.

    A null text counts as empty, and all empty texts form one group. A null id ranks after every other; a group that
    has only null ids has a null keep_id, and its rows count as kept. Rows that repeat an id are one document: they all
    count in group_size and carry the same verdict. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.col(text_col)
    norm = without_white_space(text)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("_size"),
        norm.alias("_norm"),
        F.unhex(F.md5(norm.cast("binary"))).alias("_hash"),
    )
    # the complement turns the order of ids round and, unlike a negation, has a value for every one
    best = F.max(F.struct("_size", F.bitwise_not("doc_id").alias("_id"))).alias("_best")
    size = F.count(F.lit(1)).alias("group_size")
    keep = F.bitwise_not(F.col("_best._id")).alias("keep_id")
    checked = rows.groupBy("_hash").agg(size, best, F.min("_norm").alias("_low"), F.max("_norm").alias("_high"))
    clash = F.col("_low") != F.col("_high")
    checked = stored(checked.select("_hash", "group_size", keep, clash.alias("_clash")), "groups")
    slim = rows.select("doc_id", "_hash", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"))
    settled = spread_join(slim, checked, "_hash")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    found = settled.where(~F.col("_clash")).select(*out)

    clashing = checked.where("_clash").select("_hash")
    if not clashing.isEmpty():
        by_bytes = rows.join(clashing, "_hash", "left_semi").groupBy("_hash", "_norm").agg(size, best)
        by_bytes = by_bytes.select(F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"), "group_size", keep)
        again = spread_join(settled.where("_clash").select("doc_id", "text_sha256"), by_bytes, "text_sha256")
        found = found.unionByName(again.select(*out))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
