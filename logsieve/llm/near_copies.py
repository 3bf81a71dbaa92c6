"""Near copies by Jaccard similarity of word shingles: SimHash classes and MinHash bands name candidates, exact similarity decides.

SimHash links reach the closest copies, whatever their bands; the bands reach copies down to the threshold, which lie too many bits
apart for blocks of a fingerprint.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm import simhash
from logsieve.llm.components import components
from logsieve.llm.work import spread_join, stored

WORDS = 5
LEAST_JACCARD = 0.8
#: A pair of similarity 0.8 agrees in all values of one band with probability 0.26, so 24 bands miss it once in 1,400 times.
BANDS, ROWS = 24, 6
#: So many sets are compared with so many others in one go.
BLOCK, SHARE = 256, 4096
#: So many texts are turned into shingles in one go.
TEXTS = 500

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words; a shorter text is one shingle, one without words has none."""
    found = (text or "").lower().encode().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(hashes))
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        total = _mixed(total * _ODD + hashes[i : i + len(total)])
    return np.unique(total)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of ROWS MinHash values; the band's number is part of the key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS + _SHIFTS >> np.uint64(20)).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _ODD + row)
    return keys


def _form(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of TEXTS rows at the most, so that a task holds the shingles of a few texts and not those of a whole batch."""
    for frame in frames:
        for at in range(0, len(frame), TEXTS):
            yield frame.iloc[at : at + TEXTS]


def _prints(words: int):
    def prints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _slices(frames):
            sets = [shingles(t, words) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64").array, "form": [_form(s) for s in sets], "n": [len(s) for s in sets],
                    "keys": [band_keys(s).view(np.int64) for s in sets], "fp": [simhash.fingerprint(t, words) for t in frame["text"]],
                }
            )

    return prints


def _sets(words: int):
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _slices(frames):
            found = [shingles(t, words) for t in frame["text"]]
            yield pd.DataFrame({"form": [_form(s) for s in found], "hashes": [s.view(np.int64) for s in found]})

    return sets


def _shingle_sets(forms: DataFrame, rows: DataFrame, points: DataFrame, words: int) -> DataFrame:
    """(form, hashes) of the given forms. Only texts that have one of them are turned into shingles."""
    ids = points.join(forms, "form", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    read = rows.join(ids, rows["doc_id"].eqNullSafe(ids["_rep"]), "left_semi").mapInPandas(_sets(words), "form long, hashes array<long>")
    return stored(read.join(forms, "form", "left_semi").dropDuplicates(["form"]), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of forms whose Jaccard similarity is ``least`` or more."""
    for end in "ab":
        pairs = spread_join(pairs, sets.select(F.col("form").alias(end), F.col("hashes").alias(f"_{end}")), end)
    both = F.array_size(F.array_intersect("_a", "_b"))
    either = F.array_size("_a") + F.array_size("_b") - both
    return stored(pairs.where(both >= F.lit(least) * either).select("a", "b"), "near")


def _block_links(left: list[tuple], right: list[tuple], least: float) -> set[tuple[int, int]]:
    """Pairs of classes of which some (class, hashes) of either side have a similarity of ``least`` or more."""
    known = np.unique(np.concatenate([h for _, h in left]))
    flat = np.concatenate([h for _, h in right])
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    there = known[at] == flat
    size = np.array([len(h) for _, h in right])
    owner, at = np.repeat(np.arange(len(right)), size)[there], at[there]
    found = set()
    for own, hashes in left:
        mark = np.zeros(len(known), bool)
        mark[np.searchsorted(known, hashes)] = True
        both = np.bincount(owner[mark[at]], minlength=len(right))
        found |= {(own, right[i][0]) for i in np.flatnonzero(both >= least * (len(hashes) + size - both))}
    return {(x, y) for x, y in found if x != y}


def _linker(least: float):
    """Links of classes from rows in order of group and role: a group's few (role 0) are compared with all of its rows (role 1)."""

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, few = None, []
        for frame in frames:
            groups = frame[["key", "part", "share", "role"]].to_numpy()
            cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1
            found = set()
            for low, high in zip([0, *cuts], [*cuts, len(groups)]):
                *group, role = groups[low].tolist()
                rows = [(c, h.astype(np.int64)) for c, h in zip(frame["class"][low:high], frame["hashes"][low:high])]
                if group != current:
                    current, few = group, []
                if role == 0:
                    few += rows
                elif few:
                    for at in range(0, len(rows), BLOCK):
                        found |= _block_links(few, rows[at : at + BLOCK], least)
            yield pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return link


def simhash_keys(prints: DataFrame) -> DataFrame:
    """(form, n, key): one key per class of fingerprints (prints: form, n, fp) that links of op1's distance connect."""
    fps = prints.select("fp").distinct()
    classes = components(simhash.links(fps.select("fp", F.col("fp").alias("rep"))))
    named = spread_join(prints, classes.select(F.col("node").alias("fp"), "component"), "fp", "left")
    return named.select("form", "n", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key")).distinct()


def links(rows: DataFrame, points: DataFrame, prints: DataFrame, words: int = WORDS, least: float = LEAST_JACCARD, few: int = BLOCK, many: int = SHARE) -> DataFrame:
    """Links (a, b) between forms whose components are those of 'similarity of ``least`` or more', for the pairs that share a bucket.

    ``points`` has one row per distinct set of shingles (form, rep, n, keys), ``prints`` the fingerprints of these sets' texts (form, n, fp).
    A bucket is a band or a class of SimHash links. Every member of a bucket is compared with the bucket's smallest one first. From then on only buckets with several classes matter. There, the members outside the
    bucket's largest class are compared with all members, inside tasks, ``few`` against ``many`` at a time; no pair becomes a
    row, and what comes out are the classes that belong together. So no pair of two classes is given up, and a bucket of m members
    of which k are outside its largest class costs m * k / ``few`` rows at the most.
    """
    members = points.where("n > 0").select("form", "n", F.explode("keys").alias("key")).unionByName(simhash_keys(prints))
    first = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("form", "n")).alias("x"))
    members = stored(spread_join(members, stored(first.where("_n > 1").drop("_n"), "buckets"), "key"), "members")
    alike = lambda n, m: F.least(n, m) >= F.lit(least) * F.greatest(n, m)
    stars = members.where((F.col("form") != F.col("x.form")) & alike(F.col("n"), F.col("x.n")))
    stars = stored(stars.select(F.col("x.form").alias("a"), F.col("form").alias("b")).distinct(), "pairs")
    ends = stars.select(F.col("a").alias("form")).unionByName(stars.select(F.col("b").alias("form"))).distinct()
    near = _verified(stars, _shingle_sets(ends, rows, points, words), least)

    found = stored(components(near), "classes")
    members = spread_join(members.select("key", "form"), found.select(F.col("node").alias("form"), "component"), "form", "left")
    members = stored(members.select("key", "form", F.coalesce("component", "form").alias("class")), "members")
    sizes = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    sizes = sizes.agg(F.sum("c").alias("m"), F.max(F.struct("c", "class")).alias("x")).where(F.col("m") > F.col("x.c"))
    mixed = stored(sizes.select("key", F.col("x.class").alias("main"), F.ceil((F.col("m") - F.col("x.c")) / few).alias("parts"), F.ceil(F.col("m") / many).alias("shares")), "mixed")
    members = stored(spread_join(members, mixed, "key"), "members")
    sets = _shingle_sets(members.select("form").distinct(), rows, points, words)

    one, every = lambda c, seed: F.pmod(F.xxhash64("form", F.lit(seed)), c), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    out = members.where("class != main").withColumn("part", one(F.col("parts"), 1)).withColumn("share", every("shares")).withColumn("role", F.lit(0).cast("long"))
    all_ = members.withColumn("share", one(F.col("shares"), 2)).withColumn("part", every("parts")).withColumn("role", F.lit(1).cast("long"))
    group = ["key", "part", "share"]
    dealt = spread_join(out.unionByName(all_).select(*group, "role", "form", "class"), sets, "form").drop("form")
    more = dealt.repartition(*group).sortWithinPartitions(*group, "role").mapInPandas(_linker(least), "a long, b long")
    return near.unionByName(stored(more.distinct(), "near"))


def one_per_class(docs: DataFrame, words: int = WORDS, least: float = LEAST_JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, null last, one of them where that row is repeated.

    A class is what is connected by pairs of texts whose sets of ``words``-word shingles have a Jaccard similarity of
    ``least`` or more. Whole texts are read, in lower case; a text of fewer words is one shingle, and texts without a word are
    one class. Equal sets are merged before anything is paired, so a group of copies costs one point, whatever its size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    points = rows.mapInPandas(_prints(words), "doc_id long, form long, n int, keys array<long>, fp long")
    prints = stored(points, "prints")
    reps = prints.groupBy("form", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    reps = reps.groupBy("form").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copies")).alias("y"))
    reps = reps.select("form", F.col("y.doc_id").alias("rep"), F.col("y.copies").alias("copies"))
    fps = stored(prints.where("n > 0").select("form", "n", "fp").distinct(), "fingerprints")
    points = stored(spread_join(prints.select("form", "n", "keys").dropDuplicates(["form"]), reps, "form"), "points")
    classes = components(links(rows, points, fps, words, least))
    known = points.join(classes, points["form"] == classes["node"], "left")
    known = known.select(F.coalesce("component", "form").alias("class"), F.struct(F.col("rep").isNull(), "rep", "form", "copies").alias("x"))
    kept = known.groupBy("class").agg(F.min("x").alias("x"))
    kept = stored(kept.select(F.struct("x.rep", "x.form").alias("place"), F.col("x.copies").alias("copies")), "kept")
    # texts are dealt once; only rows that are there several times are dealt again
    own = F.struct(F.col(id_col).cast("long").alias("rep"), F.pandas_udf(_forms(words), "long")(text).alias("form"))
    near = spread_join(docs.select(F.struct("*").alias("row"), own.alias("place")), kept, "place")
    once, again = near.where("copies = 1"), near.where("copies > 1").dropDuplicates(["place"])
    return once.unionByName(again).select("row.*")


def _forms(words: int):
    def forms(texts: pd.Series) -> pd.Series:
        return pd.Series([_form(shingles(t, words)) for t in texts], dtype="int64")

    return forms
