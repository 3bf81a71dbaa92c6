"""Scoring texts by prediction by partial matching over bytes, the trie being a table.

A text is coded as its words, A-Z in lower case, with a space between them and a line end at the close. A symbol's context is
the ORDER bytes before it, back to the line end that stands before the text. A context that has seen T symbols, U of them
distinct, gives (2n - 1) / 2T to one seen n times, and U / 2T to the escape to the context without its oldest byte (method D).
What the longer context has seen is excluded there: it can only have seen what the shorter one has, so the mass to take off is
one number per context. After the empty context come all symbols never seen, in equal parts; a context that was never seen is
passed over. A gram, a context with its symbol, costs the same wherever it stands, and each distinct gram is priced once.
"""

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.work import new_folder, remainder, shared_folder, spread_join, stored

ORDER = 5
SYMBOLS = 256
#: The most frequent grams and words are read by every task, so many at the most; the rest is looked up by joins.
HEAD_GRAMS, HEAD_WORDS = 1 << 21, 1 << 18
#: Bytes of text that are turned into grams at a time, and whose counts are added up before they leave the task.
_PIECE, _SLICE = 1 << 21, 1 << 23

# A gram is one long: length of the context (3 bits), its bytes with the oldest on top (40 bits), the symbol (8 bits).
_LENGTH, _SYMBOL = 40, 8


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, split at ASCII white space."""
    return (text or "").encode().lower().split()


def grams_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some texts, given as words, one text after the other, and the number of grams of each."""
    lines = [b" ".join(words) for words in texts]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    data = bytes(7) + b"\n" + b"\n".join(lines) + b"\n"
    # the 8 bytes that end at each symbol, as one number: an overlapping view of the text
    window = np.ndarray((int(lengths.sum()),), ">u8", data, offset=1, strides=(1,)).astype(np.int64)
    grams = window & ((1 << 8 * (ORDER + 1)) - 1) | ORDER << _LENGTH + _SYMBOL
    begins = np.cumsum(lengths) - lengths
    for length in range(1, ORDER):  # near the line end before the text contexts are shorter
        at = begins[lengths >= length] + length - 1
        grams[at] = window[at] & ((1 << 8 * (length + 1)) - 1) | length << _LENGTH + _SYMBOL
    return grams, lengths


def _total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of some ``size`` bytes of text, one text at the least, which bounds what a task holds at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of some texts with how often the training texts have them; grams of the others with 0."""
    for part in _slices(batches, _SLICE):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for piece in _slices([part], _PIECE):
            grams, lengths = grams_of([words_of(t) for t in piece.column("text").to_pylist()])
            learned = np.repeat(~np.array(piece.column("held_out").to_pylist(), bool), lengths)
            for chosen, weight in ((grams[learned], 1), (grams[~learned], 0)):
                distinct, n = np.unique(chosen, return_counts=True)
                keys.append(distinct)
                counts.append(n * weight)
        distinct, n = _total(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(distinct), "n": pa.array(n)})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of some texts with how often the training texts have them; words of the others with 0."""
    for part in _slices(batches, _SLICE):
        learned, seen = Counter(), set()
        for text, held_out in zip(part.column("text"), part.column("held_out").to_pylist()):
            (seen.update if held_out else learned.update)(words_of(text.as_py()))
        words = [*learned, *(seen - learned.keys())]
        counts = [*learned.values(), *[0] * (len(words) - len(learned))]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "n": pa.array(counts, pa.int64())})


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): every gram of (text, held_out) rows, n times in those not held out."""
    return docs.select("text", "held_out").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of (text, held_out) rows, n times in those not held out."""
    return docs.select("text", "held_out").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbol(gram: str) -> Column:
    return F.col(gram).bitwiseAND((1 << _SYMBOL) - 1)


def _shorter(context: Column, length: Column) -> Column:
    """The context cut to its last ``length`` bytes."""
    bytes_kept = F.element_at(F.array(*[F.lit((1 << 8 * i) - 1).cast("long") for i in range(ORDER + 1)]), (length + 1).cast("int"))
    marks = F.element_at(F.array(*[F.lit(i << _LENGTH).cast("long") for i in range(ORDER + 1)]), (length + 1).cast("int"))
    return context.bitwiseAND(bytes_kept).bitwiseOR(marks)


def trie(grams: DataFrame) -> DataFrame:
    """(ctx, sym, n, total, distinct, excluded): one row per symbol seen in a context of any length, with what the
    context saw altogether and the mass of its symbols in the next shorter context."""
    cuts = F.explode(F.sequence(F.lit(0), F.shiftright("gram", _SYMBOL + _LENGTH).cast("int"))).alias("length")
    every = grams.where("n > 0").select(F.shiftright("gram", _SYMBOL).alias("whole"), _symbol("gram").alias("sym"), "n", cuts)
    every = every.groupBy(_shorter(F.col("whole"), F.col("length")).alias("ctx"), "sym").agg(F.sum("n").alias("n"))
    every = stored(every, "grams")
    length = F.shiftright("ctx", _LENGTH)
    above = every.select(F.col("ctx").alias("up"), "sym", F.col("n").alias("n_up"))
    linked = every.withColumn("up", F.when(length > 0, _shorter(F.col("ctx"), length - 1))).join(above, ["up", "sym"], "left")
    stats = linked.groupBy("ctx").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n_up"), F.lit(0)).alias("excluded")
    )
    return stored(every.join(stats, "ctx"), "trie")


def prices(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """(gram, price): log10 probability of every gram in ``asked`` (gram), distinct, by the trie ``seen``.

    One pass per context length; only grams still without a price go on to the shorter context.
    """
    stats = stored(seen.groupBy("ctx").agg(*[F.first(c).alias(c) for c in ("total", "distinct", "excluded")]), "contexts")
    known = seen.select("ctx", "sym", "n")
    none = F.lit(0).cast("long")
    waiting = asked.select(
        "gram", F.shiftright("gram", _SYMBOL).alias("ctx"), _symbol("gram").alias("sym"), F.lit(0.0).alias("so_far"),
        none.alias("gone"), none.alias("gone_kinds"),
    )
    done = []
    for _ in range(ORDER + 1):
        here = waiting.join(stats, "ctx", "left").join(known, ["ctx", "sym"], "left")
        here = here.withColumn("left", F.col("total") - F.col("gone")).withColumn("kinds", F.col("distinct") - F.col("gone_kinds"))
        here = stored(here, "pending")
        done.append(here.where("n is not null").select("gram", (F.col("so_far") + F.log10((2 * F.col("n") - 1) / (2 * F.col("left")))).alias("price")))
        after, length = here.where("n is null"), F.shiftright("ctx", _LENGTH)
        escape = F.when(F.col("left") > 0, F.log10(F.col("kinds") / (2 * F.col("left"))))
        paid = F.col("so_far") + F.coalesce(escape, F.lit(0.0))
        rest = F.lit(SYMBOLS) - F.coalesce("distinct", none)
        done.append(after.where(length == 0).select("gram", (paid - F.log10(rest)).alias("price")))
        waiting = after.where(length > 0).select(
            "gram", _shorter(F.col("ctx"), length - 1).alias("ctx"), "sym", paid.alias("so_far"),
            F.coalesce("excluded", "gone").alias("gone"), F.coalesce("distinct", "gone_kinds").alias("gone_kinds"),
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _head(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``counted`` (n), ``most`` at the most: all with at least some count."""
    coarse = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("cast(pow(2, floor(log2(n))) as long)"))
    sizes = counted.where("n > 0").groupBy(coarse.alias("least")).count().orderBy(F.desc("least")).collect()  # some thousand rows at most
    least, total = None, 0
    for size in sizes:
        total += size["count"]
        if total > most:
            break
        least = size["least"]
    return counted.where(F.col("n") >= least) if least else counted.limit(0)


class Places:
    """Places of distinct integers, found for whole arrays at once: open addressing over a table a quarter full."""

    def __init__(self, keys: np.ndarray) -> None:
        self._bits = max(4, (4 * len(keys)).bit_length())
        self._keys, self._table = np.append(keys, 0), np.full(1 << self._bits, -1, np.int32)
        waiting, slot = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(waiting):
            free = self._table[slot] < 0
            self._table[slot[free]] = waiting[free]  # of several the last one stays
            lost = self._table[slot] != waiting
            waiting, slot = waiting[lost], self._next(slot[lost])

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self._bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is none of them."""
        slot = self._first(keys)
        out = self._table[slot]
        open_ = np.flatnonzero((out >= 0) & (self._keys[out] != keys))
        slot = slot[open_]
        while len(open_):
            slot = self._next(slot)
            out[open_] = found = self._table[slot]
            wrong = (found >= 0) & (self._keys[found] != keys[open_])
            open_, slot = open_[wrong], slot[wrong]
        return out


def _read_heads(grams: str, words: str) -> tuple[dict[bytes, int], Places, np.ndarray]:
    """The heads' words with counts and grams with prices, from the shared folder. A task that ends lets go of them."""
    tables = []
    for uri in (grams, words):
        system, path = shared_folder(uri)
        tables.append(pq.read_table(path, filesystem=system))
    keys, prices = (tables[0].column(c).to_numpy() for c in ("gram", "price"))
    places = dict(zip(tables[1].column("word").to_pylist(), tables[1].column("n").to_pylist()))
    return places, Places(keys), np.append(prices, 0.0)  # place -1 has a price too, which nothing uses


def _scorer(head_grams: str, head_words: str) -> Callable:
    """Per document a row with what the heads price, and rows for its other grams and words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known, price = _read_heads(head_grams, head_words)
        for part in _slices(batches, _PIECE):
            texts = [words_of(t) for t in part.column("text").to_pylist()]
            grams, lengths = grams_of(texts)
            at = known.find(grams)
            there = at >= 0
            priced = np.add.reduceat(np.where(there, price[at], 0.0), np.cumsum(lengths) - lengths)
            rare = np.flatnonzero(~there)
            doc = np.searchsorted(np.cumsum(lengths), rare, side="right")
            distinct, place = np.unique(grams[rare], return_inverse=True)
            pairs, times = np.unique(doc * max(1, len(distinct)) + place, return_counts=True)

            n_known, plain, docs, words, counts = [], [], [], [], []
            for i, own in enumerate(texts):
                n = np.fromiter(map(places.get, own, repeat(0)), np.int64, len(own))
                head = n[n > 0]
                n_known.append(len(head))
                plain.append(float(np.log10(head + 1.0).sum()))
                if len(head) < len(own):
                    others = Counter([own[k] for k in np.flatnonzero(n == 0).tolist()])
                    docs += [i] * len(others)
                    words += others.keys()
                    counts += others.values()
            yield _rows(part, np.arange(len(texts)), n_words=[len(w) for w in texts], n_known=n_known, plain=plain, price=priced)
            yield _rows(part, pairs // max(1, len(distinct)), gram=distinct[pairs % max(1, len(distinct))], times=times)
            yield _rows(part, np.array(docs, np.int64), word=words, times=counts)

    return score


PARTS = "doc_id long, version long, held_out boolean, n_words long, n_known long, plain double, price double, gram long, word binary, times long"
_TYPES = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _rows(own: pa.RecordBatch, at: np.ndarray, **columns: object) -> pa.RecordBatch:
    """Rows of PARTS: the document's own columns of the rows ``at``, the given columns, and null for the rest."""
    out, index = {}, pa.array(at)
    for name, kind in (part.split() for part in PARTS.split(", ")):
        if name in columns:
            out[name] = pa.array(columns[name], _TYPES[kind])
        else:
            out[name] = own.column(name).take(index) if name in own.schema.names else pa.nulls(len(at), _TYPES[kind])
    return pa.RecordBatch.from_pydict(out)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from whole texts of the rows where ``held_out`` does not hold. ``score`` is its log10 probability of the
    text, ``base_score`` that of single tokens with one added to each count. Tokens are words and one end.

    Grams and words are counted inside the map tasks first. The most frequent ones, up to a fixed number, are read by every
    task from the shared folder: these are the hot keys, and the bound does not grow with the data. Every other gram or word of a document becomes a
    row and is looked up by a join, so the trie and the vocabulary may have any size. The texts are not shuffled.

    A null text counts as empty: one end token. Repeated rows are learned from and scored as often as they come. A null
    id is kept. With nothing to learn from, every symbol has the same probability. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), held_out.alias("held_out"), text.alias("text"))
    words, grams = stored(word_counts(rows), "words"), stored(gram_counts(rows), "gram-counts")
    learned, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    tokens, vocabulary = learned + ends, distinct + int(ends > 0)

    priced = stored(prices(grams.select("gram"), trie(grams)), "prices")
    top_grams, top_words = new_folder(spark, "head-grams"), new_folder(spark, "head-words")
    _head(grams, head_grams).join(priced, "gram").select("gram", "price").write.parquet(top_grams)
    _head(words, head_words).write.parquet(top_words)
    parts = stored(rows.mapInArrow(_scorer(top_grams, top_words), PARTS), "parts")

    own = ["doc_id", "version", "held_out"]
    none = [F.lit(0).cast("long"), F.lit(0.0)]
    base = parts.where("times is null").select(*own, F.lit(1).alias("rows"), "n_words", "n_known", "plain", "price")
    more = spread_join(parts.where("gram is not null").select(*own, "gram", "times"), priced, "gram")
    more = more.select(*own, F.lit(0).alias("rows"), none[0].alias("n_words"), none[0].alias("n_known"), none[1].alias("plain"), (F.col("times") * F.col("price")).alias("price"))
    rare = spread_join(parts.where("word is not null").select(*own, "word", "times"), words, "word")
    rare = rare.select(
        *own, F.lit(0).alias("rows"), none[0].alias("n_words"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.col("n") + 1)).alias("plain"), none[1].alias("price"),
    )
    sums = base.unionByName(more).unionByName(rare).groupBy(*own).agg(*[F.sum(c).alias(c) for c in ("rows", "n_words", "n_known", "plain", "price")])
    # rows that repeat each other have been added up
    result = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    n_tokens = F.col("n_words") / F.col("rows") + 1
    total = F.log10(F.lit(float(tokens + vocabulary + 1)))
    return result.select(
        "doc_id", "held_out", n_tokens.cast("long").alias("n_tokens"),
        (F.col("n_known") / F.col("rows") + int(ends > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("plain") / F.col("rows") + F.log10(F.lit(float(ends + 1))) - n_tokens * total).alias("base_score"),
        (F.col("price") / F.col("rows")).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """A seventh of the ids, by checksum."""
    return remainder(id_col, 7) == 2
