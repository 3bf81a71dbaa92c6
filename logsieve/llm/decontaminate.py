"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences.

Benchmark items are cut into passages. Their TF-IDF matrix is reduced by a randomised SVD to a latent space. Every window
of every document is projected into it and compared with all passages there; how far the true cosine can be from the one
seen there is known, and what may reach the threshold gets its plain cosine. Near items are then compared word by word.
"""

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a window and of a passage; windows start every half of that.
WINDOW = 48
RANK, OVERSAMPLE, SEED = 256, 16, 7_919
#: The latent space keeps this share of the passages' squared length. More dimensions cost each window more, fewer leave more
#: pairs to the plain cosine; results are the same.
ENERGY = 0.95
#: Terms in a larger share of all document windows say nothing about an item.
MAX_SHARE = 0.1
CANDIDATE_COSINE = 0.4
#: Sums in single precision are this near at the least.
ROUNDING = 1e-4
#: A leak has this share of the item's words in order, or the lower one with the answer and the rarer words there.
COPIED, REWORDED, ANSWERED = 0.7, 0.5, 0.75
#: ASCII letters and digits, and bytes of other characters, make up words; all else parts them.
_PARTS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return (text or "").lower().encode().translate(_PARTS).split()


def common_subsequence(masks: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence; ``masks`` has for each word the bits of its places in the item."""
    full = (1 << length) - 1
    row = full
    for word in words:
        hit = row & masks.get(word, 0)
        row = (row + hit | row - hit) & full
    return length - row.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


class Item:
    """A benchmark item's words, its answer (the last quarter, three words at least) and its rarer words."""

    def __init__(self, words: list[bytes], common: set[bytes]) -> None:
        self.words, self.common = words, common
        answer, rare = words[-max(3, len(words) // 4) :], [w for w in words if w not in common]
        self._whole, self._answer, self._rare = ((_masks(w), len(w)) for w in (words, answer, rare))

    def compare(self, words: list[bytes]) -> tuple[float, float, float]:
        """Best share of the item, with the shares of its answer and rarer words there, over stretches of the words that
        are half as long again as the item. Nothing is found where too few of its words occur at all."""
        n, there = len(self.words), set(words)
        if sum(w in there for w in self.words) < REWORDED * n:
            return 0.0, 0.0, 0.0
        size, best = n + n // 2, (0.0, 0.0, 0.0)
        for at in range(0, max(1, len(words) - size + 1 + max(1, n // 4)), max(1, n // 4)):
            part = words[at : at + size]
            share = common_subsequence(*self._whole, part) / n
            if share > best[0]:
                rare = [w for w in part if w not in self.common]
                best = (share, common_subsequence(*self._answer, part) / self._answer[1], common_subsequence(*self._rare, rare) / self._rare[1] if self._rare[1] else share)
        return best


def passages_of(words: list, size: int = WINDOW) -> list[list]:
    """Windows of ``size`` words, half overlapping; a text that is shorter is one window, and no window is a mere rest."""
    half = size // 2
    return [words[a : a + size] for a in range(0, max(1, len(words) - half), half)] if words else []


def _window_counts(place: dict[bytes, int]) -> Callable:
    """Number of windows that have each term; the number of windows goes under term -1."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = len(place)
        for frame in frames:
            total, windows = np.zeros(terms, np.int64), 0
            for text in frame["text"]:
                words = words_of(text)
                ids = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                at = np.flatnonzero(ids >= 0)
                each = np.unique(at // WINDOW * terms + ids[at]) % terms
                total += np.bincount(each, minlength=terms)
                windows += -(-len(words) // WINDOW)
            there = np.flatnonzero(total)
            yield pd.DataFrame({"term": np.r_[-1, there], "n": np.r_[windows, total[there]]})

    return count


def _spread(rows: DataFrame, product: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], height: int, width: int) -> np.ndarray:
    """Sum of the (row, values) that ``product`` yields per task, element by element, as a matrix."""
    parts = rows.mapInPandas(product, "row int, values array<double>").select("row", F.posexplode("values").alias("place", "value"))
    sums = parts.groupBy("row", "place").agg(F.sum("value").alias("value")).toArrow()  # columns, not a Python object per number
    out = np.zeros((height, width))
    row, place, value = (sums.column(c).to_numpy() for c in ("row", "place", "value"))
    out[row, place] = value
    return out


def randomised_svd(passages: DataFrame, terms: int, rank: int = RANK, seed: int = SEED, energy: float = 1.0) -> np.ndarray:
    """Right singular vectors (terms x rank) of the sparse matrix whose rows are ``passages`` (ids, weights).

    Of these the first that together hold ``energy`` of the rows' squared length, ``rank`` at the most.

    Two passes over the rows, which stay where they are: the tasks' products A'(A R) with a random R span the range, and the
    products (A Q)'(A Q) with its orthonormal basis Q give the rotation. The driver holds terms x rank numbers.
    """
    rank = min(rank, terms)
    wide = min(rank + OVERSAMPLE, terms)

    def project(frame: pd.DataFrame, basis: np.ndarray) -> list:
        return [(np.asarray(i), np.asarray(w), np.asarray(w) @ basis[np.asarray(i)]) for i, w in zip(frame["ids"], frame["weights"])]

    def ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, total = np.random.default_rng(seed).standard_normal((terms, wide)), {}
        for frame in frames:
            for ids, weights, there in project(frame, start):
                for i, w in zip(ids.tolist(), weights.tolist()):
                    total[i] = total.get(i, 0) + w * there
        if total:
            yield pd.DataFrame({"row": [*total], "values": [*total.values()]})

    basis = np.linalg.qr(_spread(passages, ranged, terms, wide))[0]

    def crossed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((wide, wide))
        for frame in frames:
            for _, _, there in project(frame, basis):
                total += np.outer(there, there)
        yield pd.DataFrame({"row": range(wide), "values": [*total]})

    inner = _spread(passages, crossed, wide, wide)
    values, turned = np.linalg.eigh(inner)
    if energy < 1.0:
        held = np.cumsum(values[::-1])
        rank = min(rank, int(np.searchsorted(held, energy * held[-1])) + 1)
    return basis @ turned[:, ::-1][:, :rank]


class Index:
    """Terms with weights and latent vectors, and the passages of the items in the latent space."""

    def __init__(self, items: dict[int, list[bytes]], place: dict[bytes, int], weight: np.ndarray, latent: np.ndarray) -> None:
        common = {w for w, i in place.items() if weight[i] == 0}
        self.place = {w: i for w, i in place.items() if weight[i] > 0}
        self.items = {key: Item(words, common) for key, words in items.items()}
        self.vectors, self.squares = (weight[:, None] * latent).astype(np.float32), weight**2
        self.weight = weight
        self.owners, rows, beyond = [], [], []
        entries: list[tuple[np.ndarray, np.ndarray]] = []
        for key, words in items.items():
            for passage in passages_of(words):
                ids = [self.place[w] for w in passage if w in self.place]
                norm = np.sqrt(self.squares[ids].sum())
                row = self.vectors[ids].sum(0) / norm if norm else np.zeros(latent.shape[1])
                terms, times = np.unique(np.array(ids, np.int64), return_counts=True)
                values = times * weight[terms] / max(norm, 1e-9)
                self.owners.append(key)
                rows.append(row)
                beyond.append((values**2).sum() - (row.astype(np.float64) ** 2).sum())
                entries.append((terms, values))
        self.passages = np.array(rows, np.float32).reshape(-1, latent.shape[1])
        #: How much of each passage lies outside the latent space, as a length.
        self._beyond = np.sqrt(np.maximum(beyond, 0.0))
        terms = np.concatenate([t for t, _ in entries]) if entries else np.empty(0, np.int64)
        order = np.argsort(terms, kind="stable")
        self._passage_n = np.bincount(terms, minlength=len(weight))
        self._passage_begin = np.cumsum(self._passage_n) - self._passage_n
        self._passage_of = np.repeat(np.arange(len(entries)), [len(t) for t, _ in entries])[order]
        self._passage_value = np.concatenate([v for _, v in entries])[order] if entries else np.empty(0)
        self._bound_tables(items, weight)

    def _bound_tables(self, items: dict[int, list[bytes]], weight: np.ndarray) -> None:
        """For each term the items that have it, and the largest square of its share in one of an item's passages."""
        shares: list[dict[int, float]] = [{} for _ in weight]
        for number, words in enumerate(items.values()):
            for passage in passages_of(words):
                ids, times = np.unique([self.place[w] for w in passage if w in self.place], return_counts=True)
                values = (times * weight[ids.astype(int)]) ** 2
                whole = (times * self.squares[ids.astype(int)]).sum()  # a cosine's norm counts a word as often as it stands there
                for i, v in zip(ids.astype(int).tolist(), (values / max(whole, 1e-9)).tolist()):
                    shares[i][number] = max(v, shares[i].get(number, 0.0))
        self._n_of = np.array([len(x) for x in shares], np.int64)
        self._begin = np.cumsum(self._n_of) - self._n_of
        self._item = np.array([k for x in shares for k in x], np.int64)
        self._share = np.array([v for x in shares for v in x.values()], np.float64)

    def _hopeful(self, ids: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
        """Whether a window, two half windows from each block on, can have a cosine of CANDIDATE_COSINE with some passage: of the
        window only the terms of that item count, so the cosine's square is at most their weight times their shares
        there, over the window's whole weight."""
        times = self._n_of[ids]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self._begin[ids], times)
        cell, n = np.repeat(block, times) * len(self.items) + self._item[place], blocks * len(self.items)
        weight = np.bincount(cell, np.repeat(self.squares[ids], times), n).reshape(blocks, -1)
        share = np.bincount(cell, self._share[place], n).reshape(blocks, -1)
        whole = np.bincount(block, self.squares[ids], blocks)
        both = lambda x: x + np.concatenate([x[1:], np.zeros_like(x[:1])])
        return (both(weight) * both(share)).max(1) >= CANDIDATE_COSINE**2 * both(whole) * (1 - 1e-6)

    def near(self, words: list[bytes]) -> dict[int, dict[int, float]]:
        """By item, the windows (first word) with a passage of cosine CANDIDATE_COSINE or more, and the cosine."""
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at) or not len(self.owners):
            return {}
        half = WINDOW // 2
        blocks = at // half  # half windows that have terms, and where their terms begin
        found: dict[int, dict[int, float]] = {}
        for low in range(0, int(blocks[-1]) + 1, 500):  # a very long text is projected in parts
            first, last = np.searchsorted(blocks, [low, low + 501])
            if first == last:
                continue
            part, block = ids[at[first:last]], blocks[first:last] - low
            size = int(block[-1]) + 1
            starts = np.flatnonzero(self._hopeful(part, block, size)[:500])
            if not len(starts):
                continue
            needed = np.zeros(size + 1, bool)
            needed[starts] = needed[starts + 1] = True
            chosen = needed[block]
            if not chosen.any():
                continue
            part, block = part[chosen], block[chosen]
            here, begin = np.unique(block, return_index=True)
            sums = np.zeros((size + 1, self.vectors.shape[1]), np.float32)
            sums[here] = np.add.reduceat(self.vectors[part], begin, axis=0)
            window, term, value, norm = self._windows(part, block, starts)
            latent = (sums[starts] + sums[starts + 1]) / norm[:, None]  # a window is two half windows
            outside = np.bincount(window, value**2, len(starts)) - (latent.astype(np.float64) ** 2).sum(1)
            hopeful = latent @ self.passages.T + np.outer(np.sqrt(np.maximum(outside, 0.0)), self._beyond) >= CANDIDATE_COSINE - ROUNDING
            for w, p, cosine in self._plain(window, term, value, hopeful):
                own, start = found.setdefault(self.owners[p], {}), (low + int(starts[w])) * half
                own[start] = max(own.get(start, 0.0), cosine)
        return found

    def _windows(self, ids: np.ndarray, block: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, term, value) of the windows that begin at the blocks ``starts``, over the windows' norms, and these norms."""
        number = np.full(int(max(block[-1], starts[-1])) + 2, -1)
        number[starts] = np.arange(len(starts))
        cell = np.concatenate([number[block], np.where(block > 0, number[block - 1], -1)])
        there, terms = cell >= 0, len(self.weight)
        cells, times = np.unique(cell[there] * terms + np.concatenate([ids, ids])[there], return_counts=True)
        window, term = cells // terms, cells % terms
        norm = np.sqrt(np.maximum(np.bincount(window, times * self.squares[term], len(starts)), 1e-9))
        return window, term, times * self.weight[term] / norm[window], norm

    def _plain(self, window: np.ndarray, term: np.ndarray, value: np.ndarray, hopeful: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, passage, cosine) of the hopeful pairs whose cosine over all terms is CANDIDATE_COSINE or more."""
        chosen = np.flatnonzero(hopeful.any(1)[window])
        times = self._passage_n[term[chosen]]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self._passage_begin[term[chosen]], times)
        at = np.repeat(chosen, times)
        cell, passage = window[at], self._passage_of[entry]
        kept = hopeful[cell, passage]
        products = (value[at] * self._passage_value[entry])[kept]
        cosines = np.bincount(cell[kept] * hopeful.shape[1] + passage[kept], products, hopeful.size).reshape(hopeful.shape)
        for w, p in zip(*np.nonzero(cosines >= CANDIDATE_COSINE)):
            yield int(w), int(p), float(cosines[w, p])

    def leaks(self, text: str | None) -> Iterator[tuple[int, float, float, float]]:
        """(item, cosine, share, answer share) of every item that the text has."""
        words = words_of(text)
        for key, windows in self.near(words).items():
            item, best = self.items[key], None
            reach = len(item.words)
            for start, cosine in windows.items():
                shares = item.compare(words[max(0, start - reach) : start + WINDOW + reach])
                if best is None or shares > best[1]:
                    best = cosine, shares
            share, answer, rare = best[1]
            if share >= COPIED and rare >= REWORDED or share >= REWORDED and answer >= ANSWERED and rare >= REWORDED:
                yield key, best[0], share, answer


def build_index(docs: DataFrame, items: dict[int, list[bytes]], rank: int = RANK) -> Index:
    """The index of some items. Weights are inverse window frequencies over all documents (a column ``text``).

    Passages enter the decomposition at unit length, so that a short item counts as much as a long one. Of its dimensions those
    that hold ENERGY of them are kept, ``rank`` at the most.
    """
    spark: SparkSession = docs.sparkSession
    place = {w: i for i, w in enumerate(sorted({w for words in items.values() for w in words}))}
    counted = docs.select("text").mapInPandas(_window_counts(place), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = np.zeros(len(place) + 1, np.int64)
    for r in counted.collect():  # a number per term of the items in hand
        n[r["term"]] = r["n"]
    windows, n = max(1, n[-1]), n[:-1]
    weight = np.log1p(windows / np.maximum(n, 1))
    common = n > MAX_SHARE * windows
    # a passage of nothing but common words, as in a very small corpus, keeps them all
    kept = {i for words in items.values() for p in passages_of(words) if common[ids := [place[w] for w in p]].all() for i in ids}
    weight[[i for i in np.flatnonzero(common).tolist() if i not in kept]] = 0.0
    rows = []
    for words in items.values():
        for passage in passages_of(words):
            ids, times = np.unique([place[w] for w in passage], return_counts=True)
            values = times * weight[ids]
            rows.append((ids.tolist(), (values / max(np.linalg.norm(values), 1e-9)).tolist()))
    passages = spark.createDataFrame(rows, "ids array<int>, weights array<double>")
    return Index(items, place, weight, randomised_svd(passages, len(place), rank, energy=ENERGY))


def _searcher(index: Index) -> Callable:
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *leak) for d, text in zip(frame["doc_id"], frame["text"]) for leak in index.leaks(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "share", "answer_share"]).astype({"doc_id": "Int64"})

    return search


LEAK = "doc_id long, item_id long, cosine double, share double, answer_share double"


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rank: int = RANK,
) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_share): one row per document and benchmark item that it contains.

    Documents are read twice, once for the window counts and once for the search; nothing of them is shuffled, and a
    passage that a third of all documents share costs no more than another. Items are taken in parts of ``rank`` passages at the
    most, each part against all documents, which bounds the index that goes to the tasks; an item with more passages is a
    part of its own. The space has fewer dimensions than a part has passages, ``rank`` at the most; a passage that it shows
    badly is compared by its plain cosine with more windows, so none is lost.

    Null and empty texts match nothing, nor do items without a word. Items with a null id are left out; items of one id are one
    item, the text that comes first. Repeated documents give one row. A null doc_id is reported as null. An empty table on
    either side gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("words"))
    named = named.where("item is not null and words is not null").groupBy("item").agg(F.min("words").alias("words"))
    found, after = spark.createDataFrame([], LEAK), None
    while True:
        rest = named if after is None else named.where(F.col("item") > after)
        items, passages = {}, 0
        for row in rest.orderBy("item").limit(rank).collect():
            words = words_of(row["words"])
            if items and passages + len(passages_of(words)) > rank:
                break
            after, passages = row["item"], passages + len(passages_of(words))
            items[row["item"]] = words
        if not items:
            break
        if items := {key: words for key, words in items.items() if words}:
            found = found.unionByName(rows.mapInPandas(_searcher(build_index(rows, items, rank)), LEAK))
    best = F.max(F.struct("share", "cosine", "answer_share")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.share", "best.answer_share")


def clean(docs: DataFrame, benchmark: DataFrame, **options: str | int) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    leaks = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(leaks, F.col("row.doc_id").eqNullSafe(F.col("leak")), "left_anti").select("row.*")
