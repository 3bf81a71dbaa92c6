"""Repeated runs of lines: a suffix array over line ranks, built by prefix doubling in DataFrames."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.work import spread_join, stored

SPACE = " \t\n\x0b\f\r"
PLACE = ["doc_id", "version", "pos"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, text): rows with one id and one text are one document, and so have one (doc_id, version)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, pos, raw, words, line): one row per line that is not blank.

    ``raw`` counts all lines of the text, ``pos`` those that are not blank; ``line`` is the MD5 of the line without
    white space at its ends, ``words`` one more than the white space in it.
    """
    rows = _documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("raw"), F.btrim(x, F.lit(SPACE)).alias("form")))
    full = F.filter(every, lambda s: s["form"] != "")
    found = rows.select("doc_id", "version", F.posexplode(full).alias("pos", "_line"))
    form = F.col("_line.form")
    line, words = F.unhex(F.md5(form.cast("binary"))), F.length(form) - F.length(F.translate(form, SPACE, "")) + 1
    return found.select(*PLACE, F.col("_line.raw").alias("raw"), words.alias("words"), line.alias("line")).dropDuplicates(PLACE)


def _ranked(table: DataFrame, key: str) -> DataFrame:
    """(key, rank): dense ranks, in key order, of the keys that occur at more than one place.

    Keys are dealt by range, numbered inside each range, and the ranges' sizes added up. A key that occurs once belongs
    to no repeated run and gets no rank.
    """
    often = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    dealt = stored(often.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranks")
    inner = F.row_number().over(Window.partitionBy("range").orderBy(key))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return dealt.withColumn("inner", inner).join(sizes, "range").select(key, (F.col("inner") + F.col("before")).alias("rank"))


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """(doc_id, version, pos, rank): suffixes in the order of their first ``depth`` lines, where these occur twice or more.

    Prefix doubling: the rank of 2h lines comes from the pair of ranks of h lines at pos and pos + h; the last step
    overlaps when ``depth`` is no power of two. Suffixes of one rank are an interval of the suffix array whose longest
    common prefix has ``depth`` lines at least. Suffixes that no other shares are settled and drop out of later steps.
    """
    ranks = spread_join(lines.select(*PLACE, "line"), _ranked(lines, "line"), "line").select(*PLACE, "rank")
    done = 1
    while done < depth:
        step = min(done, depth - done)
        ranks = stored(ranks, "suffixes")
        other = ranks.select("doc_id", "version", (F.col("pos") - step).alias("pos"), F.col("rank").alias("then"))
        pairs = ranks.join(other, PLACE).select(*PLACE, F.struct("rank", "then").alias("pair"))
        ranks = spread_join(pairs, _ranked(pairs, "pair"), "pair").select(*PLACE, "rank")
        done += step
    return stored(ranks, "suffixes")


def repeated_lines(lines: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(doc_id, version, raw) of every line inside a later copy of a run of ``min_lines`` lines or more, and of every later
    copy of a line that has ``min_words`` words by itself.

    The first copy of a run is the one that comes first by (doc_id, version, pos); a copy that overlaps it in the same
    text is none. A longer repeated run is the union of its parts of ``min_lines`` lines, each of which is a repeat.
    """
    ranks = suffix_ranks(lines, min_lines)
    first = ranks.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first"))
    both = spread_join(ranks, first, "rank")
    here = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.version") == F.col("version"))
    later = both.where(F.when(here, F.col("pos") - F.col("first.pos") >= min_lines).otherwise(F.struct(*PLACE) > F.col("first")))
    covered = later.select("doc_id", "version", F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
    if min_words is not None:
        long = lines.where(F.col("words") >= min_words).select(*PLACE, "line")
        origin = long.groupBy("line").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = spread_join(long, origin.select("line", "first"), "line").where(F.struct(*PLACE) > F.col("first"))
        covered = covered.unionByName(again.select(*PLACE))
    return lines.join(covered.distinct(), PLACE, "left_semi").select("doc_id", "version", "raw")


def dedup_line_runs(docs: DataFrame, min_lines: int = 2, min_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines (not blank), n_removed, text (what stays, line ends as they were).

    Every maximal run of ``min_lines`` or more lines that occurs twice anywhere keeps its first copy; later copies are
    deleted. So are later copies of a single line of ``min_words`` words or more. Lines are compared without white space at their ends; blank lines are never part of a run and stay.

    A null text stays null, an empty one empty. A row with a null id is kept whole and is no first copy. Rows that repeat
    an id and a text are one document and lose the same lines; rows with one id and different texts are different
    documents. An empty table gives an empty result. Other columns are ignored.
    """
    lines = stored(positions(docs, id_col, text_col), "lines")
    gone = repeated_lines(lines, min_lines, min_words).groupBy("doc_id", "version").agg(F.collect_set("raw").alias("gone"))
    counts = lines.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_lines"))
    marks = counts.join(gone, ["doc_id", "version"], "left")
    rows = _documents(docs, id_col, text_col).join(marks, ["doc_id", "version"], "left")
    every = F.split("text", "\n", -1)
    # a set difference of places: looking each line up in an array would take the square of a text's lines
    places = F.array_except(F.sequence(F.lit(0), F.array_size(every) - 1), F.col("gone"))
    stay = F.transform(places, lambda i: F.get(every, i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    n_lines = F.coalesce("n_lines", F.lit(0))
    return rows.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).alias("n_removed"), text.alias("text"))
