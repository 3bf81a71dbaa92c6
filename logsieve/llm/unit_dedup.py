"""Substring de-duplication by hashing lines or paragraphs: the first occurrence of a unit stays."""

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.work import spread_join

#: Where a unit ends. Sentence units end at line ends too.
ENDS = {
    "paragraph": re.compile(r"\n[ \t\r]*\n"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"\n|(?<=[.!?])[ \t\r]+|(?<=[。！？])(?![。！？])[ \t\r]*"),
}
#: Thai, Lao, Burmese, Khmer, Kana and Han: written without spaces, so that a code point counts as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
UNITS = "doc_id long, version long, at int, end int, words int, digest binary"
PLACE = ["doc_id", "version", "at"]


def normalised(unit: str) -> str:
    """Lower case, without punctuation at the ends of words, single spaces."""
    return " ".join(w for w in (w.strip(".,;:!?\"'()[]") for w in unit.lower().split()) if w)


def units_of(text: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of every unit that has a word; offsets in code points of the original text."""
    at = 0
    for end in ENDS[kind].finditer(text):
        if form := normalised(text[at : end.start()]):
            yield at, end.start(), form
        at = end.end()
    if form := normalised(text[at:]):
        yield at, len(text), form


def words_in(form: str) -> int:
    """Words of a normalised unit, or code points of scripts without spaces where these are more."""
    spaced = form.count(" ") + 1
    return spaced if form.isascii() else max(spaced, len(UNSPACED.findall(form)))


def _splitter(kind: str) -> Callable:
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 500):
                rows = []
                part = frame.iloc[lo : lo + 500]
                for doc_id, version, text in zip(part["doc_id"], part["version"], part["text"]):
                    for at, end, form in units_of(text, kind):
                        rows.append((doc_id, version, at, end, words_in(form), md5(form.encode()).digest()))
                yield pd.DataFrame(rows, columns=["doc_id", "version", "at", "end", "words", "digest"])

    return split


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, text): rows with one id and one text are one document, and so have one (doc_id, version)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def units(docs: DataFrame, kind: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every unit of every text that has one: doc_id, version, at, end, words, digest (MD5 of the normalised unit)."""
    rows = _documents(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return rows.mapInPandas(_splitter(kind), UNITS)


def later_copies(
    docs: DataFrame, kind: str = "sentence", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", min_stretch: int | None = None
) -> DataFrame:
    """(doc_id, version, at, end) of every unit to remove.

    The first occurrence of a digest is the one with the smallest (doc_id, version, at). A later one of ``min_words`` words or
    more goes. A shorter one says little by itself: it goes only where the unit beside it in its text, with nothing but
    the gap between them, is a removed long one. With ``min_stretch``, later units beside each other are joined into stretches,
    and a stretch of that many words together goes whole, however short its units are.
    """
    found = units(docs, kind, id_col, text_col)
    first = found.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", "first")
    later = spread_join(found, first, "digest").where(F.struct(*PLACE) > F.col("first"))
    later = later.select(*PLACE, "end", "words").distinct()
    # one document's later copies at a time; two are beside each other when only a unit end lies between them
    inside = Window.partitionBy("doc_id", "version").orderBy("at")
    long = F.col("words") >= min_words
    near = lambda gap, other: F.coalesce((gap <= 3) & other, F.lit(False))
    after = near(F.col("at") - F.lag("end").over(inside), F.lag(long).over(inside))
    before = near(F.lead("at").over(inside) - F.col("end"), F.lead(long).over(inside))
    goes = long | after | before
    if min_stretch is not None:
        begins = F.coalesce((F.col("at") - F.lag("end").over(inside) > 3).cast("int"), F.lit(0))
        later = later.withColumn("_begins", begins).withColumn("_stretch", F.sum("_begins").over(inside))
        goes |= F.sum("words").over(Window.partitionBy("doc_id", "version", "_stretch")) >= min_stretch
    return later.withColumn("_goes", goes).where("_goes").select(*PLACE, "end")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans, the white space that followed each one included."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
    return "".join([*kept, text[at:]])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut(t, [(s["at"], s["end"]) for s in found]) for t, found in zip(texts, spans)], dtype=object)


def dedup_units(
    docs: DataFrame, kind: str = "sentence", min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", min_stretch: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, text (what stays), removed (array of at, end in the original text), n_removed.

    Units are normalised (case, white space, punctuation at word ends), hashed, and grouped over all documents; see
    ``later_copies`` for what goes. Digests that occur once leave the data before anything is joined, and the digest of a
    very common unit is counted inside the map tasks first.

    A null text stays null, an empty one empty; neither has units. A row with a null id is kept whole and stands for no
    first occurrence. Rows that repeat an id and a text are one document and lose the same units; rows with one id
    and different texts are different documents. An empty table gives an empty result. Other columns are ignored.
    """
    gone = later_copies(docs, kind, min_words, id_col, text_col, min_stretch)
    spans = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("removed"))
    found = _documents(docs, id_col, text_col).join(spans, ["doc_id", "version"], "left")
    none = F.array().cast("array<struct<at:int,end:int>>")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.pandas_udf(_cut, "string")(F.coalesce("text", F.lit("")), F.coalesce("removed", none))
    )
    return found.select(
        "doc_id", text.alias("text"), F.coalesce("removed", none).alias("removed"),
        F.coalesce(F.array_size("removed"), F.lit(0)).alias("n_removed"),
    )
