"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, connected classes."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import components
from logsieve.llm.work import spread_join, stored

BITS = 64
MAX_DISTANCE = 3
#: 6 blocks of which 3 must agree: keys of at least 31 bits. 16 blocks of which 13 must agree: 12 bits are free, so a
#: bucket holds at most 4096 different fingerprints.
FIRST_BLOCKS, NEXT_BLOCKS = 6, 16


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Majority of the XXH64 bits of all word shingles; A-Z in lower case, words are runs of non-space bytes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        first, last = (ends - lengths)[: len(words) - words_per_shingle + 1], ends[words_per_shingle - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""
    # null is made empty first: pandas would show a column of nulls as floats
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(_fingerprints, "long")(text).alias("fp"))


def _masks(blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - MAX_DISTANCE`` blocks, as signed longs.

    At most MAX_DISTANCE blocks can hold the bits in which a close pair differs, so the pair agrees on one mask.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    widths = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(widths, blocks - MAX_DISTANCE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _keyed(points: DataFrame, blocks: int) -> DataFrame:
    """Every point once per mask, with the block key it has there."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks)])
    out = points.select("*", F.posexplode(masks).alias("_table", "_mask"))
    return out.withColumn("_key", F.col("fp").bitwiseAND(F.col("_mask"))).drop("_mask")


def _tree(fps: np.ndarray) -> np.ndarray:
    """For each point the index of one it hangs on: a forest with the components of 'at most 3 bits apart'."""
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ x) <= MAX_DISTANCE) for x in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _link_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside runs of equal (_table, _key); a run lies in one partition, in order, and is of bounded size."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        key = frame[["_table", "_key"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(frame) else np.array([0])
        done, held = frame.iloc[: starts[-1]], frame.iloc[starts[-1] :]
        yield _links_of(done, starts)
    if held is not None and len(held):
        yield _links_of(held, np.array([0, len(held)]))


def _links_of(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    fps, ids = frame["fp"].to_numpy(), frame["rep"].to_numpy()
    a, b = [], []
    for lo, hi in zip(starts[:-1], starts[1:]):
        on = _tree(fps[lo:hi].astype(np.uint64))
        moved = np.flatnonzero(on != np.arange(hi - lo))
        a.append(ids[lo:hi][moved])
        b.append(ids[lo:hi][on[moved]])
    return pd.DataFrame({"a": np.concatenate(a or [ids[:0]]), "b": np.concatenate(b or [ids[:0]])})


def _in_buckets(rows: DataFrame) -> DataFrame:
    runs = rows.repartition("_table", "_key").sortWithinPartitions("_table", "_key")
    return runs.mapInPandas(_link_runs, "a long, b long")


def links(points: DataFrame, most: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of 'fingerprints at most 3 bits apart'.

    ``points`` has one row per distinct fingerprint (fp, rep), ``rep`` being the smallest id that has it. Buckets of two
    are checked by Spark itself; larger ones in numpy, which returns a spanning forest and not all pairs. A bucket of
    more than ``most`` fingerprints goes on to the finer blocks, where all but 12 of the 64 bits are shared: copies
    were merged before, so such a bucket has at most 4096 rows however many documents there are. No pair is given up.
    """
    keyed = _keyed(points, FIRST_BLOCKS)
    point = F.struct("fp", "rep")
    sizes = keyed.groupBy("_table", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min(point).alias("x"), F.max(point).alias("y"))
    sizes = stored(sizes.where("_n > 1"), "buckets")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_DISTANCE
    of_two = sizes.where((F.col("_n") == 2) & close).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    larger = keyed.join(sizes.where("_n > 2").select("_table", "_key", "_n"), ["_table", "_key"])
    small = larger.where(F.col("_n") <= most).drop("_n")
    hot = larger.where(F.col("_n") > most).select("fp", "rep").distinct()
    return of_two.unionByName(_in_buckets(small)).unionByName(_in_buckets(_keyed(hot, NEXT_BLOCKS)))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2048) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, class_size (rows in the component).

    component_id is the smallest id reachable over links of at most 3 differing bits, the row's own id included. Whole
    texts are read; one of fewer than three words is hashed as one shingle, and an empty or null text has fingerprint
    zero and is linked like any other. Equal fingerprints are merged before anything is paired, so a group of copies
    costs one point, whatever its size. Repeated rows share their class. A null id is never the smallest; documents
    with nothing but null ids have a null class. An empty table gives an empty result. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_copies"))
    points = stored(points, "points")
    classes = components(links(points.where("rep is not null").select("fp", "rep"), most))
    linked = points.join(classes, points["rep"] == classes["node"], "left")
    linked = linked.select("fp", "_copies", F.coalesce("component", "rep").alias("component_id"))
    sizes = linked.groupBy("component_id").agg(F.sum("_copies").alias("class_size"))
    linked = spread_join(linked.drop("_copies"), sizes, "component_id", "left")
    found = spread_join(prints, linked, "fp")
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "class_size")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the row whose id is the class's, one of them where that row is repeated.

    A row with a null id stays only where all rows of its fingerprint have none; then one of them does.
    """
    classes = near_duplicates(docs, id_col, text_col)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, docs[id_col].cast("long") == kept["_kept"], "left_semi").dropDuplicates([id_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    nameless = docs.where(F.col(id_col).isNull()).withColumn("_print", hex_digits(F.pandas_udf(_fingerprints, "long")(text)))
    alone = classes.where("component_id is null").select(F.col("fingerprint").alias("_print")).distinct()
    return named.unionByName(nameless.join(alone, "_print", "left_semi").dropDuplicates(["_print"]).drop("_print"))
