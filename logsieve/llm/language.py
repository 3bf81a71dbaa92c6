"""Language identification with hyperdimensional profiles."""

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.work import remainder

DIMENSIONS = 1024
SEED = 20_011
UNDETERMINED = "und"
#: Vectors of n-grams that a worker keeps; others are made again when they come up.
KEPT_VECTORS = 20_000

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        kinds = (unicodedata.category(chr(c)) for c in range(0x110000))
        _letters = np.fromiter((k[0] in "LM" for k in kinds), bool, 0x110000)
    return _letters[codes]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a whole text and their counts.

    Letters are in lower case; every run of other characters is one gap, and so are both ends. A trigram is three code
    points of 21 bits, a gap being 0. Trigrams with a gap in the middle are left out. A text without a letter has none.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(_is_letter(codes), codes, 0).astype(np.uint64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    return np.unique(packed[codes[1:-1] != 0], return_counts=True)


class Vectors:
    """Random letter vectors of +1 and -1, bound into one vector per trigram: letters are rotated by their place."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self._dimensions, self._seed = dimensions, seed
        self._letter: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._table = np.zeros((256, dimensions), np.int8)  # +1 and -1: a byte each

    def _of_letter(self, code: int) -> np.ndarray:
        if code not in self._letter:
            bits = np.random.default_rng([self._seed, code]).integers(0, 2, self._dimensions)
            self._letter[code] = (2 * bits - 1).astype(np.float32)
        return self._letter[code]

    def _bind(self, gram: int) -> np.ndarray:
        first, second, third = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self._of_letter(first), 2) * np.roll(self._of_letter(second), 1) * self._of_letter(third)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each as often as it occurs."""
        rows = np.array([self._row.get(g, -1) for g in grams.tolist()], np.int64)
        total = np.zeros(self._dimensions, np.float64)
        for i in np.flatnonzero(rows < 0).tolist():
            gram = int(grams[i])
            vector = self._bind(gram)
            if len(self._row) < KEPT_VECTORS:
                rows[i] = self._row[gram] = len(self._row)
                if rows[i] == len(self._table):
                    self._table = np.vstack([self._table, np.zeros_like(self._table)])
                self._table[rows[i]] = vector
            else:
                total += vector * float(counts[i])
        there = np.flatnonzero(rows >= 0)
        for at in range(0, len(there), 1024):
            part = there[at : at + 1024]
            total += counts[part].astype(np.float32) @ self._table[rows[part]].astype(np.float32)
        return total


_vectors: dict[tuple[int, int], Vectors] = {}


def _shared(dimensions: int, seed: int) -> Vectors:
    return _vectors.setdefault((dimensions, seed), Vectors(dimensions, seed))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts by language, added up over each batch."""
    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            total: dict[int, int] = {}
            for text in texts:
                for gram, n in zip(*(x.tolist() for x in trigrams(text))):
                    total[gram] = total.get(gram, 0) + n
            yield pd.DataFrame({"lang": lang, "gram": np.array([*total], np.int64), "n": np.array([*total.values()], np.int64)})


def _bundled(dimensions: int, seed: int) -> Callable:
    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                vector = _shared(dimensions, seed).bundle(part["gram"].to_numpy(np.uint64), part["n"].to_numpy())
                sums[lang] = sums.get(lang, 0) + vector
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": vector})

    return bundle


def prototypes(labeled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundles, from (text, lang) rows.

    Trigrams are counted by language over all rows first, so every task bundles a part of the distinct trigrams. What
    comes to the driver is the model: one vector of ``dimensions`` numbers per language, however many rows there are.
    """
    counted = labeled.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counted.mapInPandas(_bundled(dimensions, seed), "lang string, place int, value double")
    rows = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    found = np.zeros((len(langs), dimensions))
    for r in rows:
        found[langs.index(r["lang"]), r["place"]] = r["value"]
    return langs, found


def predictor(langs: list[str], bundles: np.ndarray, seed: int = SEED) -> Callable[[Column], Column]:
    """Column function: the language whose prototype has the largest cosine with the text's bundle, and that cosine."""
    dimensions = bundles.shape[1]
    norms = np.linalg.norm(bundles, axis=1, keepdims=True)
    unit = bundles / np.where(norms == 0, 1, norms)

    def one(text: str | None) -> tuple[str, float]:
        grams, counts = trigrams(text)
        if not len(grams) or not langs:
            return UNDETERMINED, 0.0
        bundle = _shared(dimensions, seed).bundle(grams, counts)
        cosines = unit @ bundle / max(np.linalg.norm(bundle), 1e-12)
        best = int(np.argmax(cosines))
        return langs[best], float(min(1.0, max(0.0, cosines[best])))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    # null is made empty first: pandas would show a column of nulls as floats
    return lambda text: predict(F.coalesce(text, F.lit("")))


def identify(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), learned from its rows where ``learn_from`` holds.

    Only text and a non-null language of those rows are learned from; a prediction sees the text alone. A null text, and
    one without a letter, gives ``und`` and score 0, as does every text when there is nothing to learn from. Equal
    cosines go to the language that comes first by name. Other columns are kept; columns named lang_pred or score are
    replaced.
    """
    labeled = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs, bundles = prototypes(labeled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), dimensions, seed)
    found = predictor(langs, bundles, seed)(F.col(text_col))
    rest = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(F.struct(*rest).alias("row"), found.alias("found")).select("row.*", "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by checksum."""
    return remainder(id_col, 4) == 2
