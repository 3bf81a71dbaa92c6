"""License scans: ordered signature rules behind a keyword filter; detections inside better ones are suppressed."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.license_rules import CONFIDENCE, GATES, RULES, Rule
from logsieve.llm.work import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULE = "array<struct<rule int, label string, level int, keyword string, pattern string, base boolean>>"
_START, _END = "\x01", "\x02"


def words_of(text: Column) -> Column:
    """The text's words with a blank on either side of each, so that neighbouring matches share no blank; '' without words."""
    words = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _rule_list(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.level).alias("level"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.base).alias("base"))
        for i, r in enumerate(rules)
    ])


def _places(words: Column, pattern: Column) -> Column:
    """[(first, last)] of every match, in words from 0: matches are marked, and marks are counted off the words before them."""
    marked = F.regexp_replace(words, pattern, F.lit(f" {_START} $0 {_END} "))
    tokens = F.filter(F.split(marked, " "), lambda w: w != "")
    at = lambda mark: F.filter(F.transform(tokens, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
    return F.transform(F.arrays_zip(at(_START).alias("a"), at(_END).alias("b")), lambda x, k: F.struct((x["a"] - 2 * k).alias("first"), (x["b"] - 2 * k - 2).alias("last")))


def detections(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, rule, label, level, base, first, last) of every match of every rule in rows (row, words).

    Only the rules whose keyword stands in a text are tried on it.
    """
    near = rows.select("row", "words", F.explode(F.filter(_rule_list(rules), lambda r: F.contains("words", r["keyword"]))).alias("r"))
    hit = near.where(F.regexp("words", F.col("r.pattern")))
    every = hit.select("row", "r.rule", "r.label", "r.level", "r.base", F.explode(_places(F.col("words"), F.col("r.pattern"))).alias("x"))
    return every.select("row", "rule", "label", "level", "base", "x.first", "x.last")


def unsuppressed(found: DataFrame) -> DataFrame:
    """``found`` with ``stays``: whether no detection of the same or a better level contains it.

    In the order of first word, last word downwards, level and rule, whatever contains a detection comes before it; so it is
    enough to know how far the earlier ones reach, per level. Of equal intervals the better level stays, then the first rule.
    """
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(-1)
    for level in range(len(CONFIDENCE)):
        own = F.max(F.when(F.col("level") <= level, F.col("last"))).over(before)
        reach = F.when(F.col("level") == level, F.coalesce(own, F.lit(-1))).otherwise(reach)
    return found.withColumn("stays", reach < F.col("last"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, gates: tuple[str, ...] = GATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Base rules count at every
    place and keep their labels; of the other rules a label needs a detection that no other one suppresses. ``score`` is the
    confidence of the best detection, 0 without one. Labels are distinct, sorted and joined by commas.

    ``gates`` are literals of which every keyword has one. A text without any is settled by them alone; of the others the words
    are stored once and each rule whose keyword is there is tried. Detections of one text, never more than its words times the
    rules, are ordered in a window. Texts are not shuffled.

    A null or empty text, or one without words, has n_words 0, no labels ('') and null places. A null id is kept, and rows that
    repeat each other are scanned each. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    gate = F.lit(False)
    for literal in gates:
        gate = gate | F.contains("words", F.lit(literal.replace(" ", "  ")))
    blanks = F.length("words") - F.length(F.translate("words", " ", ""))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), (blanks / 2).cast("long").alias("n_words"), F.when(gate, F.col("words")).alias("words"))
    rows = stored(rows, "words")

    found = unsuppressed(detections(rows.where(F.col("words").isNotNull()), rules))
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("level") + 1)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    each = found.where("stays or base").groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max(confidence).alias("score"),
    )
    out = rows.select("row", "doc_id", "n_words").join(each, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
