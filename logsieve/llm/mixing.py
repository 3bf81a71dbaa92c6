"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.hashing import md5_number
from logsieve.llm.work import spread_join, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Slots of the schedule, as long as blocks have LONGEST words at the most; a larger corpus has more slots, not longer blocks. A
#: source's words are met to a few blocks, so blocks must not grow past what a small source has.
SLOTS = 1 << 18
LONGEST = 64
#: Golden-ratio step over 2**32 points.
STEP, POINTS = 2_654_435_769, 1 << 32


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources by code point, null last, take the weights in turn. The level at which the capped targets add up to
    ``share`` of all words is found by ordering sources by the level that fills them: those before the first level that
    fits stop at ``most`` times their size, and the others get weight times level. The rows are sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    upward = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    below = upward.rowsBetween(Window.unboundedPreceding, -1)
    here = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    level = (wanted - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(here)
    per = per.withColumn("level", F.when(level <= F.col("full_at"), level))
    level = F.max("level").over(everything)  # the first that fits: levels only fall from there
    # a level that no source fits under (share above the caps) leaves every source at its cap
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def schedule(goals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, source, rank): slot n belongs to the source into whose part of the cumulative targets point n falls.

    Points are n times the golden ratio modulo 1, in integers. Points and parts meet in 4096 cells of the unit interval.
    Ranks of a source's slots are counted inside runs of 4096 slots and over the runs, so no task sees all slots of a
    source.
    """
    spark = goals.sparkSession
    upward = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    ends = goals.where("target > 0").withColumn("end", F.sum("target").over(upward)).withColumn("total", total)
    edge = lambda c: F.floor(c / F.col("total") * POINTS)
    parts = ends.select("source", edge(F.col("end") - F.col("target")).alias("low"), edge(F.col("end")).alias("high"))
    cell = lambda c: F.shiftright(c, 20)
    parts = parts.where("low < high").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * STEP % POINTS).alias("point"))
    found = points.withColumn("cell", cell(F.col("point"))).join(parts, "cell").where("low <= point and point < high")
    found = found.select("slot", F.floor(F.col("slot") / 4096).alias("run"), source_key("source").alias("key"), "source")
    inner = F.row_number().over(Window.partitionBy("run", "key").orderBy("slot")) - 1
    runs = found.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.withColumn("inner", inner).join(runs, ["key", "run"])
    return ranked.select("slot", "source", (F.col("inner") + F.col("before")).cast("long").alias("rank"))


def source_key(source: str) -> Column:
    """A key that is never null, so that documents without a source are joined like the others."""
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))


def placed(sizes: DataFrame) -> DataFrame:
    """Documents laid end to end in their source, in the order of a hash of the id: adds ``start``, in words.

    Offsets are added up in two steps, inside ranges of the hash that hold a thousand rows over all sources, and over the ranges.
    """
    rows = sizes.where("size > 0").withColumn("hash", md5_number("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranges = max(1, sizes.count() // 1024)
    rows = rows.withColumn("range", F.floor(F.col("hash") * F.lit(ranges) / POINTS))
    order = Window.partitionBy("key", "range").orderBy("hash", F.col("doc_id").asc_nulls_last(), "size")
    inner = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("key", "range").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = rows.withColumn("inner", inner).join(sums, ["key", "range"])
    return found.select("doc_id", "key", "size", (F.col("inner") + F.col("before")).alias("start"))


def mix(
    docs: DataFrame, slots: int = SLOTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    longest: int = LONGEST,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Each source's documents are laid out in hashed order and cut into blocks of equally many words, ``longest`` at the most,
    the last one of a source being shorter. The schedule's slots of a source take its blocks in turn and start over when all are taken;
    a block is taken ``most`` times at the most. ``taken`` is the number of the document's words in taken blocks,
    repeats counted. The hash depends on the id alone, so reruns agree.

    A null or empty text has size 0 and takes nothing; null sources are one source. Repeated rows lie side by side in
    the layout and count each. When no document has a word, every target is 0. An empty table gives an empty result.
    """
    sizes = sized(docs, id_col, text_col, source_col)
    sizes = stored(sizes.withColumn("key", source_key("source")), "sizes")
    goals = stored(targets(sizes, most=most), "targets")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    block = max(1, min(longest, math.ceil(total / slots)))
    blocks = goals.select(source_key("source").alias("key"), F.ceil(F.col("source_size") / block).alias("blocks"))
    taken = schedule(goals, round(total / block)).withColumn("key", source_key("source")).join(blocks, "key")
    taken = taken.where(F.col("rank") < F.lit(most) * F.col("blocks")).groupBy("key", (F.col("rank") % F.col("blocks")).alias("block"))
    taken = taken.agg(F.count(F.lit(1)).alias("times"))
    rows = placed(sizes).withColumn("end", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    pieces = rows.withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least(F.col("end"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.withColumn("words", words).join(taken, ["key", "block"], "left")
    got = pieces.groupBy("key", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    got = got.select("doc_id", "key", "size", F.col("taken").cast("long").alias("taken"))
    none = sizes.where("size = 0").select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"))
    ends = goals.select(source_key("source").alias("key"), "source_size", "target")
    found = spread_join(got.unionByName(none), ends, "key")
    return found.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with every row as often as the mix takes it: words taken over words there, rounded to the nearest.

    Rows of one id share their count. Documents that the mix leaves out, and those without a word, are gone.
    """
    copies = mix(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = copies.where("taken > 0").select("doc_id", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(copies.where("copies > 0"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
