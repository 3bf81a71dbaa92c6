"""Ranked lexical search: the documents of a block are grouped by the set of query terms they hold, and groups that cannot win are left out.

A term is a run of letters, digits and bytes above ASCII, A-Z in lower case. A posting is a (document, term, count). Blocks of
documents are searched for every item: the item's terms become bitmaps over the block, a document's column of bits is its mask,
and a mask's score cannot exceed the sum of its terms' best contributions in the block. Masks are evaluated by that bound, the
highest first, until it is below the score of the last place, so the result is that of scoring every document.
"""

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.work import new_folder, shared_folder, spread_join, stored

#: Length normalisation: parts of a hundred that do and do not depend on the document's length, and the saturation of counts.
FLAT, BY_LENGTH, SATURATION = 25, 75, 8
#: A block ends at so many documents or postings; a batch of items is what a task holds of them at once.
BLOCK_DOCS, BLOCK_POSTINGS, ITEM_BATCH = 1 << 14, 1 << 21, 1 << 11
#: Terms are sifted by a table of 2^20 checksums before they leave the task, whatever the number of items.
_SIEVE = 1 << 20
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def _counted(sieve: bytes | None) -> Callable:
    """Per row its number of terms, and each distinct one that the sieve lets through with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                sizes, terms, times, ends = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    found = terms_of(text)
                    sizes.append(len(found))
                    for term, n in Counter(found).items():
                        if sieve is None or sieve[zlib.crc32(term) & _SIEVE - 1]:
                            terms.append(term)
                            times.append(n)
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.binary()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "times"])

    return count


def postings(rows: DataFrame, sieve: bytes | None = None) -> DataFrame:
    """(id, n, terms, times) of rows (id, text): whole texts, null as empty."""
    rows = rows.select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_counted(sieve), "id long, n long, terms array<binary>, times array<long>")


def sieve_of(terms: DataFrame) -> bytes:
    """A byte for each remainder of a checksum that some row of ``terms`` (term) has; 1 MB at the most, whatever their number."""
    slot = F.crc32("term").bitwiseAND(F.lit(_SIEVE - 1)).cast("int")
    table = np.zeros(_SIEVE, np.uint8)
    table[terms.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = 1
    return table.tobytes()


class Block:
    """Postings of some documents, by term: documents, and what a term of weight one adds to each one's score."""

    def __init__(self, parts: list[pa.RecordBatch], n_docs: int, n_terms: int):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.ids = table.column("id").to_pylist()
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(self.ids)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        times = table.column("times").combine_chunks().flatten().to_numpy()
        flat = FLAT + BY_LENGTH * table.column("n").to_numpy() * n_docs // max(1, n_terms)
        gain = 1_000_000_000 * times // (1_000 * times + SATURATION * flat[doc])
        order = np.argsort(code, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary))).tolist()
        self.place = {t: slice(a, b) for t, a, b in zip(coded.dictionary.to_pylist(), [0, *ends], ends)}

    def _scores(self, sel: np.ndarray, terms: list[tuple[slice, int]]) -> np.ndarray:
        total = np.zeros(len(sel), np.int64)
        for place, weight in terms:
            docs, gain = self.doc[place], self.gain[place]
            at = np.minimum(np.searchsorted(docs, sel), len(docs) - 1)
            total += np.where(docs[at] == sel, weight * gain[at], 0)
        return total

    def best(self, terms: list[bytes], weights: list[int], k: int) -> list[tuple[int, int | None]]:
        """The k highest (score, id) of the block, of equal scores the smallest ids, null last; scores of 0 are left out."""
        held = [(self.place[t], w) for t, w in zip(terms, weights) if w > 0 and t in self.place]
        if not held:
            return []
        bits = np.zeros((len(held), len(self.ids)), bool)
        for row, (place, _) in zip(bits, held):
            row[self.doc[place]] = True
        docs = np.flatnonzero(bits.any(0))
        packed = np.ascontiguousarray(np.packbits(bits[:, docs], axis=0).T)
        wide = np.zeros((len(docs), -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        mask = wide.view(np.uint64).ravel() if wide.shape[1] == 8 else wide.view(f"V{wide.shape[1]}").ravel()
        _, first, group, size = np.unique(mask, return_index=True, return_inverse=True, return_counts=True)
        highest = np.array([w * int(self.gain[p].max()) for p, w in held])
        bound = highest @ bits[:, docs[first]]

        by_bound = np.argsort(-bound, kind="stable")
        rank = np.empty_like(by_bound)
        rank[by_bound] = np.arange(len(by_bound))
        docs = docs[np.argsort(rank[group], kind="stable")]  # of the mask with the highest bound first
        ends = np.cumsum(size[by_bound])
        top: list[tuple[int, int | None]] = []
        done = at = 0
        while at < len(ends) and not (len(top) == k and bound[by_bound[at]] < top[-1][0]):
            to = max(at + 1, int(np.searchsorted(ends, done + 256)))  # whole masks, some hundred documents at a time
            sel = np.sort(docs[done : ends[to - 1]])
            scores = self._scores(sel, held)
            least = max(1, top[-1][0] if len(top) == k else 1)
            top += [(int(scores[i]), self.ids[sel[i]]) for i in np.flatnonzero(scores >= least)]
            top = sorted(top, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
            done, at = int(ends[to - 1]), to
        return top


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Block]:
    parts, rows, total = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            within = int(np.searchsorted(np.cumsum(sizes[at:]), max(1, BLOCK_POSTINGS - total), side="right"))
            take = max(1, min(within, BLOCK_DOCS - rows, batch.num_rows - at))
            parts.append(batch.slice(at, take))
            rows, total, at = rows + take, total + int(sizes[at : at + take].sum()), at + take
            if rows >= BLOCK_DOCS or total >= BLOCK_POSTINGS or at < batch.num_rows:
                yield Block(parts, n_docs, n_terms)
                parts, rows, total = [], 0, 0
    if parts:
        yield Block(parts, n_docs, n_terms)


def _searcher(items: str, n_docs: int, n_terms: int, k: int) -> Callable:
    """Every item of the folder ``items`` against each block of a task's documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = shared_folder(items)
        source = ds.dataset(path, filesystem=system, format="parquet")
        for block in _blocks(batches, n_docs, n_terms):
            for batch in source.to_batches(batch_size=ITEM_BATCH, batch_readahead=1, fragment_readahead=1):
                item, doc, score = [], [], []
                for i, terms, weights in zip(*(batch.column(c).to_pylist() for c in ("item", "terms", "weights"))):
                    for s, d in block.best(terms, weights, k):
                        item.append(i)
                        doc.append(d)
                        score.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], ["item", "doc_id", "score"])

    return search


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` highest-scoring documents of every row of ``items``: item_id, rank (from 1), doc_id, score.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), with N the documents that have a term. It is taken as often as the
    item repeats the term, times (10^9 tf) div (1000 tf + 8 m), m being 25 + (75 n N) div L; only scores above 0 count. Equal
    scores rank by id, null last.

    Documents are read once; what is kept of them are the counts of terms that some item has. Items are read by the tasks in
    batches from the shared folder, and a block holds at most some thousand documents, so neither side has to fit in memory.
    From each block come at most ``k`` rows an item.

    A null text has no terms: such a document is in no result, such an item has no rows. Rows that repeat a document each
    have a rank of their own, as have rows that repeat an item. A null id is kept. An empty table on either side gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    asked = stored(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = postings(asked.select(F.col("item").alias("id"), "text"))
    wanted = stored(wanted.select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "times")).alias("x")).select("item", "x.*").toDF("item", "term", "times"), "wanted")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = stored(postings(rows, sieve_of(wanted.select("term"))), "postings")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = spread_join(wanted, stored(held, "frequencies"), "term")
    weight = F.floor(1_000 * F.log((2 * F.lit(n_docs) + 2.0) / (2 * F.col("df") + 1.0))).cast("long") * F.col("times")
    each = known.groupBy("item").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("x"))
    folder = new_folder(spark, "weighted-items")
    each.select("item", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")).write.parquet(folder)

    found = counted.where(F.size("terms") > 0).mapInArrow(_searcher(folder, n_docs, n_terms, k), "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    first = found.withColumn("rank", place).where(F.col("rank") <= k)
    return spread_join(first, asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
