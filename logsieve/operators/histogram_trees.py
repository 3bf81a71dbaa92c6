"""The trees of one boosting round, grown side by side from sums by bin: one pass over packed rows a level for all of them.

Packed rows are a table of blocks: each holds some ten thousand rows as arrays (bins of all features, labels, weights, margins), so that
a pass hands arrays to numpy and no row by row values. Tasks add up their blocks by node and bin, and the driver finds the best split
of every node from these sums, whose size does not depend on the number of rows.
"""

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from math import ceil, log2, sqrt
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.session import work_dir
from logsieve.sources.tables import stored

LEAST_CURVATURE = 1e-6
#: A single row's Newton step is this long at the most, as is usual for rows that are classified badly.
LONGEST_STEP = 4.0
LEAST_CHANCE = 1e-15
#: A gain below this is rounding.
LEAST_GAIN = 1e-12
#: Rows of a block at least, where a task has so many.
BLOCK_ROWS = 16_384

PACKED = (
    "block long, bins binary, label binary, weight binary, margins binary, n_valid long, losses array<double>"
)
BLOCK, BINS, LABEL, WEIGHT, MARGINS, N_VALID, LOSSES = range(7)
#: Of a node: rows, weight, weighted step, weighted squared step.
STATS = 4
#: Features are summed together up to so many combinations of bins, over all nodes of a level up to so many.
MOST_COMBOS, LEVEL_COMBOS = 4096, 2**17
#: Rows of a tree that wait to be summed together.
WAITING_ROWS = 2**17
#: Nodes whose sums make one row of a task's result.
CHUNK = 64
#: Sums of a level that go straight to the driver; where the tasks have more, other tasks add them up first.
DIRECT_BYTES = 64 << 20
#: Blocks of a task.
TASK_BLOCKS = 128
#: Rounds between two writes of the rows.
KEPT_ROUNDS = 10


class Growth(NamedTuple):
    """Settings of a tree, as the library names them."""

    max_depth: int
    least_rows: int
    least_gain: float
    rate: float
    features: int


class Tree(NamedTuple):
    """Nodes in heap order: those below node i are 2i + 1 and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    sums: np.ndarray
    value: np.ndarray


def growth(count: int, settings: Mapping[str, Any]) -> Growth:
    """``settings`` of a tree over ``count`` features; names that are not known are an error."""
    given = {
        "maxDepth": 5, "minInstancesPerNode": 1, "minInfoGain": 0.0, "subsamplingRate": 1.0, "featureSubsetStrategy": "auto", "maxBins": 32,
        **settings,
    }
    if len(given) > 6:
        raise ValueError(f"settings of trees are {list(given)[:6]}, not {list(given)[6:]}")
    if not 2 <= given["maxBins"] <= 256:
        raise ValueError("maxBins lies between 2 and 256")
    strategy = str(given["featureSubsetStrategy"])
    named = {"auto": count, "all": count, "sqrt": ceil(sqrt(count)), "log2": max(1, ceil(log2(count))), "onethird": ceil(count / 3)}
    if strategy in named:
        chosen = named[strategy]
    else:
        chosen = ceil(float(strategy) * count) if "." in strategy else int(strategy)
    return Growth(
        given["maxDepth"], given["minInstancesPerNode"], given["minInfoGain"], given["subsamplingRate"], max(1, min(count, chosen))
    )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1), batch


def cut_points(rows: DataFrame, bins: int = 32) -> list[np.ndarray]:
    """Per feature the thresholds of its splits, at most ``bins`` - 1: between all its values if they are that few, else quantiles.

    All train rows are read. ``rows``: features, is_valid. Missing values lie above every threshold.
    """
    train = rows.where("NOT is_valid").select(vector_to_array("features").alias("features"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen: list[np.ndarray] | None = None
        for values, _ in _values(batches):
            seen = seen or [np.empty(0)] * values.shape[1]
            # a feature with more values than bins needs no more of them
            seen = [s if len(s) > bins else np.unique(np.r_[s, c[~np.isnan(c)]])[: bins + 1] for s, c in zip(seen, values.T)]
        if seen is not None:
            yield pd.DataFrame({"feature": range(len(seen)), "found": [s.tolist() for s in seen]})

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.int32()), ("found", pa.list_(pa.float64()))])
        for frame in few(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    found = train.mapInArrow(arrow, "feature int, found array<double>")
    # tasks differ in what they saw first, but a feature of few values has the same few everywhere
    listed = found.select("feature", F.explode_outer("found").alias("value")).groupBy("feature").agg(F.collect_set("value").alias("values"))
    values = {r["feature"]: np.sort(np.array(r["values"], float)) for r in listed.collect()}  # one row per feature
    if not values:
        raise ValueError("boosting needs train rows")
    many = [f for f, v in values.items() if len(v) > bins]
    shares = [i / bins for i in range(1, bins)]
    cuts = {f: (v[1:] + v[:-1]) / 2 for f, v in values.items()}
    if many:
        numbers = [F.when(~F.isnan(F.col("features")[f]), F.col("features")[f]) for f in many]
        row = train.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"q{f}") for f, x in zip(many, numbers)]).first()
        cuts |= {f: np.unique(np.array(row[f"q{f}"], float)) for f in many}
    return [cuts[f] for f in range(len(cuts))]


def packed(rows: DataFrame, cuts: Sequence[np.ndarray], outputs: int) -> DataFrame:
    """Blocks of ``rows`` (features, label, weight, is_valid) with margins of zero. A validation row has its weight with a minus."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        task, made, held = TaskContext.get().partitionId(), 0, []
        for values, batch in _values(batches):
            bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, values.T)]).astype(np.uint8)
            weight = batch.column("weight").to_numpy(zero_copy_only=False).astype(float)
            valid = batch.column("is_valid").to_numpy(zero_copy_only=False)
            held.append((bins, batch.column("label").to_numpy(zero_copy_only=False), np.where(valid, -weight, weight)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield joined((task << 32) + made, held)
                made, held = made + 1, []
        if held:
            yield joined((task << 32) + made, held)

    def joined(block: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        bins, label, weight = (np.concatenate(x, axis=-1) for x in zip(*held))
        return pd.DataFrame(
            {
                "block": [block], "bins": [bins.tobytes()], "label": [label.astype(np.int16).tobytes()], "weight": [weight.tobytes()],
                "margins": [np.zeros((outputs, len(label))).tobytes()], "n_valid": [int(np.signbit(weight).sum())], "losses": [[]],
            }
        )

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in pack(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    blob = pa.binary()
    schema = pa.schema(
        [("block", pa.int64()), ("bins", blob), ("label", blob), ("weight", blob), ("margins", blob), ("n_valid", pa.int64()), ("losses", pa.list_(pa.float64()))]
    )
    listed = rows.select(vector_to_array("features").alias("features"), "label", "weight", "is_valid")
    return listed.mapInArrow(arrow, PACKED)


class _Rows(NamedTuple):
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margins: np.ndarray


def _rows(block: Sequence[Any], features: int, outputs: int) -> _Rows:
    label = np.frombuffer(block[LABEL], np.int16)
    bins = np.frombuffer(block[BINS], np.uint8).reshape(features, len(label))
    return _Rows(bins, label, np.frombuffer(block[WEIGHT]), np.frombuffer(block[MARGINS]).reshape(outputs, len(label)))


def held(rows: DataFrame | RDD) -> RDD:
    """Packed rows as an RDD of tuples in the order of ``PACKED``: a pass over it is a job of one stage without a plan."""
    return rows.rdd.map(tuple) if isinstance(rows, DataFrame) else rows


def _chances(margins: np.ndarray) -> np.ndarray:
    """Chance of every class (rows of the array); one margin alone is that of the second of two classes."""
    if len(margins) == 1:
        margins = np.concatenate([np.zeros_like(margins), margins])
    powers = np.exp(margins - margins.max(0))
    return powers / powers.sum(0)


def newton(rows: _Rows, k: int, chances: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and Newton step of the log loss for margin ``k`` of the rows ``own``."""
    outputs = len(rows.margins)
    chance = chances[1 if outputs == 1 else k].take(own)
    curvature = np.maximum(chance * (1 - chance), LEAST_CURVATURE)
    step = ((rows.label.take(own) == (1 if outputs == 1 else k)) - chance) / curvature
    return rows.weight.take(own) * curvature, np.clip(step, -LONGEST_STEP, LONGEST_STEP)


def signs(rows: _Rows, k: int, chances: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and label (-1 or 1) of the rows ``own``: what the library's first tree of two classes is fitted to."""
    return rows.weight.take(own), 2.0 * rows.label.take(own) - 1.0


def gradient(rows: _Rows, k: int, chances: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and residual of the library's log loss, 2 log(1 + exp(-2 y F)): what its later trees are fitted to."""
    sign = 2.0 * rows.label.take(own) - 1.0
    with np.errstate(over="ignore"):
        return rows.weight.take(own), 4 * sign / (1 + np.exp(2 * sign * rows.margins[0].take(own)))


def _reached(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row reaches."""
    inner, every = tree.feature >= 0, np.arange(bins.shape[1])
    at = np.zeros(bins.shape[1], np.int64)
    if not inner.any():
        return at
    nodes = np.arange(len(inner))
    start = np.where(inner, tree.feature, 0) * bins.shape[1]
    cut, low = np.where(inner, tree.cut, 256).astype(np.int16), np.where(inner, 2 * nodes + 1, nodes)  # rows stay in a leaf
    flat = bins.reshape(-1)
    for _ in range(int(nodes[inner][-1] + 1).bit_length()):
        at = low.take(at) + (flat.take(start.take(at) + every) > cut.take(at))
    return at


def bundles(sizes: Sequence[int], limit: int) -> list[list[int]]:
    """Features in groups, so that each group has at most ``limit`` combinations of bins (or is one feature).

    A group is summed in one go by combination of bins; adding these up gives the sums of each feature.
    """
    groups: list[list[int]] = []
    combos: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        width = sizes[f] + 1
        g = next((g for g, n in enumerate(combos) if n * width <= limit), None)
        if g is None:
            groups.append([f])
            combos.append(width)
        else:
            groups[g].append(f)
            combos[g] *= width
    return groups


def _by_feature(table: np.ndarray, group: Sequence[int], widths: Sequence[int], out: dict[int, np.ndarray]) -> None:
    """Sums by combination of bins (last axis) as sums by bin of each feature of the group."""
    if len(group) == 1:
        out[group[0]] = table
        return
    half = len(group) // 2
    split = table.reshape(*table.shape[:-1], int(np.prod([widths[f] for f in group[:half]])), -1)
    _by_feature(split.sum(-1), group[:half], widths, out)
    _by_feature(split.sum(-2), group[half:], widths, out)


class _Sums:
    """Sums of the nodes of one tree by feature and bin, over rows that come in parts."""

    def __init__(self, count: int, groups: Sequence[Sequence[int]], widths: Sequence[int]) -> None:
        self.count, self.groups, self.widths = count, groups, widths
        self.combos = [int(np.prod([widths[f] for f in g])) for g in groups]
        self.tables = [np.zeros((STATS, count * n)) for n in self.combos]
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, node: np.ndarray, codes: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        self.waiting.append((node, codes, weight, step))
        if sum(len(w[0]) for w in self.waiting) >= WAITING_ROWS:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        node, codes, weight, step = (np.concatenate(x, axis=-1) for x in zip(*self.waiting))
        self.waiting = []
        weighted = weight * step
        values = (None, weight, weighted, weighted * step)
        for table, combos, code in zip(self.tables, self.combos, codes):
            key = node * combos + code
            for j, value in enumerate(values):
                table[j] += np.bincount(key, value, table.shape[1])

    def result(self) -> np.ndarray:
        """Nodes, statistics, bins of all features one after the other."""
        self.flush()
        found: dict[int, np.ndarray] = {}
        for table, combos, group in zip(self.tables, self.combos, self.groups):
            _by_feature(table.reshape(STATS, self.count, combos), group, self.widths, found)
        return np.concatenate([found[f] for f in range(len(self.widths))], axis=-1).transpose(1, 0, 2).copy()


def _level_sums(
    trees: Sequence[Tree], places: Sequence[np.ndarray], sizes: Sequence[int], seed: int, rate: float, aim: Callable[..., Any]
):
    """Sums of the nodes of a level by feature and bin, a few nodes to a row from each task, and the losses of its rows.

    ``places``: per tree, the number of each node among those of the level to be summed, or -1.
    """
    features, widths = len(sizes), [n + 1 for n in sizes]
    counts = [int(p.max()) + 1 for p in places]
    groups = bundles(sizes, min(MOST_COMBOS, max(64, LEVEL_COMBOS // max(1, *counts))))
    trees = [t._replace(gain=None, sums=None, value=None) for t in trees]

    def level(part: int, blocks: Iterator[Sequence[Any]]) -> Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]:
        sums = [_Sums(n, groups, widths) for n in counts]
        told = np.zeros(2)
        for block in blocks:
            rows = _rows(block, features, len(trees))
            codes = np.zeros((len(groups), len(rows.label)), np.uint16)
            for code, group in zip(codes, groups):
                for f in group:
                    code *= np.uint16(widths[f])
                    code += rows.bins[f]
            valid = np.signbit(rows.weight)
            told += (block[LOSSES][-1] if len(block[LOSSES]) else 0.0), -rows.weight[valid].sum()
            chances, train = _chances(rows.margins) if aim is newton else None, ~valid
            for k, (tree, place) in enumerate(zip(trees, places)):
                if not counts[k]:
                    continue
                here = train
                if rate < 1:
                    here = train & (np.random.default_rng([seed, k, block[BLOCK]]).random(len(train)) < rate)
                at = place.take(_reached(tree, rows.bins))
                own = np.flatnonzero(here & (at >= 0))
                sums[k].add(at.take(own), codes.take(own, axis=1), *aim(rows, k, chances, own))
        yield (-1, 0), (part, told)
        for k, own in enumerate(sums):
            found = own.result() if own.count else ()
            for first in range(0, own.count, CHUNK):
                yield (k, first), (part, found[first : first + CHUNK])

    return level


def _in_order(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Parts added up in the order of their tasks, so that a run gives the sums of another."""
    total = None
    for _, part in sorted(parts, key=lambda p: p[0]):
        total = part if total is None else total + part
    return total


def _added(found: RDD, size: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all tasks. ``size``: bytes that a task gives. Where they are many, other tasks add them up."""
    if found.getNumPartitions() * size <= DIRECT_BYTES:
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for key, part in found.collect():
            parts.setdefault(key, []).append(part)
        return {key: _in_order(some) for key, some in parts.items()}
    return dict(found.groupByKey(min(found.getNumPartitions(), found.context.defaultParallelism)).mapValues(_in_order).collect())


def _best_splits(sums: np.ndarray, sizes: np.ndarray, drawn: np.ndarray, least_rows: int, least_gain: float):
    """Per node the split with the highest gain (decrease of the variance) among the features drawn for it.

    ``sums``: nodes, statistics, bins of all features. Returns feature (-1: none), cut, gain, and the sums of the node and of both sides.
    """
    width, ends = max(sizes) + 1, np.cumsum(sizes + 1)
    places = np.arange(width) + (ends - sizes - 1)[:, None]
    places = np.where(np.arange(width) <= sizes[:, None], places, sums.shape[-1])
    sums = np.concatenate([sums, np.zeros((*sums.shape[:-1], 1))], axis=-1)[:, :, places]
    here = sums[:, :, 0].sum(-1)
    left = sums.cumsum(-1)[..., :-1]
    right = here[:, :, None, None] - left
    least = max(least_rows, 1)
    allowed = (np.arange(width - 1) < sizes[:, None]) & drawn[:, :, None]
    allowed &= (left[:, 0] >= least) & (right[:, 0] >= least) & (left[:, 1] > 0) & (right[:, 1] > 0)
    if not allowed.size:
        return np.full(len(sums), -1), np.full(len(sums), -1), np.zeros(len(sums)), here, here, here
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = (here[:, 2] ** 2 / here[:, 1])[:, None, None]
        gains = (left[:, 2] ** 2 / left[:, 1] + right[:, 2] ** 2 / right[:, 1] - whole) / here[:, 1][:, None, None]
    gains = np.where(allowed, gains, -np.inf).reshape(len(sums), -1)
    best, every = gains.argmax(1), np.arange(len(sums))
    gain = gains[every, best]
    feature, cut = np.divmod(best, width - 1)
    found = gain >= max(least_gain, LEAST_GAIN)
    low, high = left[every, :, feature, cut], right[every, :, feature, cut]
    return np.where(found, feature, -1), np.where(found, cut, -1), np.where(found, gain, 0.0), here, low, high


def grow(
    rows: DataFrame | RDD, sizes: Sequence[int], outputs: int, seed: int, settings: Growth, aim: Callable[..., Any] = newton
) -> list[Tree]:
    """The trees of one round, one per margin, on the Newton steps of the log loss or another ``aim``. ``sizes``: cut points of each feature.

    Every tree takes its own sample of the train rows, and every node its own draw of features.
    """
    return grow_told(rows, sizes, outputs, seed, settings, aim)[0]


def grow_told(
    rows: DataFrame | RDD, sizes: Sequence[int], outputs: int, seed: int, settings: Growth, aim: Callable[..., Any] = newton
) -> tuple[list[Tree], tuple[float, float]]:
    """The trees as of ``grow``, and what the pass for their roots saw: the last loss of the rows, and the weight of the validation rows.

    Of two nodes with one parent only that of fewer rows is summed; the other has what is left of the parent's sums.
    """
    rows, nodes, count = held(rows), 2 ** (settings.max_depth + 1) - 1, len(sizes)
    trees = [
        Tree(np.full(nodes, -1), np.full(nodes, -1), np.zeros(nodes), np.zeros((nodes, STATS)), np.zeros(nodes)) for _ in range(outputs)
    ]
    told = (0.0, 0.0)
    open_: list[list[int]] = [[0] for _ in trees]
    above: list[dict[int, np.ndarray]] = [{} for _ in trees]
    for depth in range(settings.max_depth):
        if not any(open_):
            break
        summed = []
        for tree, some in zip(trees, open_):
            pairs = [(i, i + 1) for i in sorted({n - 1 + n % 2 for n in some})] if depth else []
            summed.append([min(pair, key=lambda n: tree.sums[n][0]) for pair in pairs] if depth else list(some))
        places = [np.full(nodes, -1) for _ in trees]
        for place, some in zip(places, summed):
            place[some] = np.arange(len(some))
        level = rows.mapPartitionsWithIndex(_level_sums(trees, places, sizes, seed, settings.rate, aim))
        found = _added(level, sum(map(len, summed)) * STATS * (sum(sizes) + count) * 8)
        if depth == 0:
            told = tuple(found[-1, 0].tolist())
        following: list[list[int]] = [[] for _ in trees]
        for k, (tree, some) in enumerate(zip(trees, summed)):
            if not some:
                continue
            own = np.concatenate([found[k, first] for first in range(0, len(some), CHUNK)])
            sums = dict(zip(some, own))
            for n in some if depth else ():
                rest = above[k][(n - 1) // 2] - sums[n]
                rest[:, rest[0] <= 0] = 0.0  # of no rows nothing is left, whatever the rounding
                sums[n - 1 if n % 2 == 0 else n + 1] = rest
            at = open_[k]
            drawn = np.ones((len(at), count), bool)
            if settings.features < count:
                drawn[:] = False
                for i, n in enumerate(at):
                    drawn[i, np.random.default_rng([seed, k, n]).choice(count, settings.features, replace=False)] = True
            splits = _best_splits(np.stack([sums[n] for n in at]), np.array(sizes), drawn, settings.least_rows, settings.least_gain)
            for n, feature, cut, gain, here, low, high in zip(at, *splits):
                if depth == 0:
                    tree.sums[0] = here
                if feature < 0:
                    continue
                tree.feature[n], tree.cut[n], tree.gain[n] = feature, cut, gain
                for child, side in ((2 * n + 1, low), (2 * n + 2, high)):
                    tree.sums[child] = side
                    if side[0] >= 2 * max(settings.least_rows, 1):
                        following[k].append(child)
            above[k] = {n: sums[n] for n in at}
        open_ = following
    for tree in trees:
        known = tree.sums[:, 1] > 0
        tree.value[known] = tree.sums[known, 2] / tree.sums[known, 1]
    return trees, told


def _log_loss(rows: _Rows, margins: np.ndarray, valid: np.ndarray) -> float:
    chance = _chances(margins[:, valid])[rows.label[valid], np.arange(len(valid))]
    return float(-np.log(np.maximum(chance, LEAST_CHANCE)).sum())


def _library_loss(rows: _Rows, margins: np.ndarray, valid: np.ndarray) -> float:
    sign = 2.0 * rows.label[valid] - 1.0
    return float((-rows.weight[valid] * 2 * np.logaddexp(0, -2 * sign * margins[0, valid])).sum())


def _moved(trees: Sequence[Tree], step: float, features: int, aim: Callable[..., Any]) -> Callable[[Sequence[Any]], tuple[Any, ...]]:
    trees, loss = [t._replace(gain=None, sums=None) for t in trees], _log_loss if aim is newton else _library_loss

    def moved(block: Sequence[Any]) -> tuple[Any, ...]:
        rows = _rows(block, features, len(trees))
        new = np.stack([m + step * t.value.take(_reached(t, rows.bins)) for m, t in zip(rows.margins, trees)])
        valid = np.flatnonzero(np.signbit(rows.weight))
        return (*block[:MARGINS], new.tobytes(), block[N_VALID], [*block[LOSSES], loss(rows, new, valid)])

    return moved


def advance(rows: DataFrame, trees: Sequence[Tree], step: float, features: int, aim: Callable[..., Any] = newton) -> DataFrame:
    """Margins after one more round, and its loss over the block's validation rows added to the list."""
    return rows.sparkSession.createDataFrame(held(rows).map(_moved(trees, step, features, aim)), PACKED, verifySchema=False)


class Rounds:
    """Packed rows that go on from round to round, kept in memory or on disk by the executors.

    After every ``KEPT_ROUNDS`` rounds they are written to shared storage, which cuts their lineage; what was written before goes,
    so that the disk holds two copies at the most however many rounds there are.
    """

    def __init__(self, start: DataFrame, features: int, aim: Callable[..., Any] = newton) -> None:
        self.spark, self.features, self.aim, self.moves = start.sparkSession, features, aim, 0
        context = self.spark.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(work_dir(self.spark))
        start = stored(start, work_dir(self.spark))
        parts = ceil(start.count() / TASK_BLOCKS / context.defaultParallelism) * context.defaultParallelism
        self.rows = held(start.repartition(max(1, parts))).persist(StorageLevel.MEMORY_AND_DISK)
        self.earlier: RDD | None = None
        self.written: list[RDD] = []

    def advance(self, trees: Sequence[Tree], step: float) -> None:
        """Call after a pass over the rows: only then the rows before them are no longer needed."""
        if self.earlier is not None:
            self.earlier.unpersist()
        moved = self.rows.map(_moved(trees, step, self.features, self.aim)).persist(StorageLevel.MEMORY_AND_DISK)
        self.earlier, self.rows, self.moves = self.rows, moved, self.moves + 1
        if self.moves % KEPT_ROUNDS == 0:
            moved.checkpoint()
            self.written.append(moved)
            last = max((i for i, rdd in enumerate(self.written) if rdd.isCheckpointed()), default=0)
            self._forget(self.written[:last])
            self.written = self.written[last:]

    def _forget(self, written: Sequence[RDD]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for rdd in written:
            if name := rdd.getCheckpointFile():
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)

    def losses(self) -> tuple[list[float], float, int]:
        """Sums over the rows: the loss of every round, the weight of the validation rows and their number."""

        def told(blocks: Iterator[Sequence[Any]]) -> Iterator[tuple[np.ndarray, float, int]]:
            for b in blocks:
                weight = np.frombuffer(b[WEIGHT])
                yield np.array(b[LOSSES], float), float(-weight[np.signbit(weight)].sum()), b[N_VALID]

        found = self.rows.mapPartitions(lambda blocks: [tuple(map(sum, zip(*t)))] if (t := list(told(blocks))) else []).collect()
        losses, weight, count = (sum(x) for x in zip(*found))
        return losses.tolist(), weight, count

    def close(self) -> None:
        self.rows.unpersist()
        if self.earlier is not None:
            self.earlier.unpersist()
        self._forget(self.written)


def library_tree(spark: SparkSession, tree: Tree, cuts: Sequence[np.ndarray]) -> DecisionTreeRegressionModel:
    """``tree`` as one of the library's, which saves, loads and scores like any other."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    # every call to the JVM takes its time, so names are looked up once and numbers sent together
    ml = jvm.org.apache.spark.ml
    calculator, leaf, inner = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, ml.tree.LeafNode, ml.tree.InternalNode
    continuous, part = ml.tree.ContinuousSplit, jvm.java.util.Arrays.copyOfRange
    numbers = gateway.new_array(jvm.double, 3 * len(tree.value))
    jvm.java.nio.ByteBuffer.wrap(tree.sums[:, 1:].astype(">f8").tobytes()).asDoubleBuffer().get(numbers)

    def stats(node: int) -> tuple[Any, float]:
        n, w, wy, wyy = tree.sums[node].tolist()
        found = calculator(part(numbers, 3 * node, 3 * node + 3), int(n))
        return found, (max(0.0, wyy / w - (wy / w) ** 2) if w > 0 else 0.0)

    def made(node: int) -> Any:
        value, (found, impurity), feature = float(tree.value[node]), stats(node), int(tree.feature[node])
        if feature < 0:
            return leaf(value, impurity, found)
        split = continuous(feature, float(cuts[feature][tree.cut[node]]))
        low, high = made(2 * node + 1), made(2 * node + 2)
        return inner(value, impurity, float(tree.gain[node]), low, high, split, found)

    uid = f"dtr_{uuid.uuid4().hex[-12:]}"
    return DecisionTreeRegressionModel(ml.regression.DecisionTreeRegressionModel(uid, made(0), len(cuts)))


def ensemble(kind: type, java_name: str, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float], *more: int) -> Any:
    """Single trees as one of the library's ensembles, which saves, loads and scores like any other."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    array = JavaWrapper._new_java_array([t._java_obj for t in trees], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    weights = JavaWrapper._new_java_array([float(w) for w in weights], jvm.double)
    uid = f"{kind.__name__}_{uuid.uuid4().hex[-12:]}"
    return kind(JavaWrapper._new_java_obj(java_name, uid, array, weights, trees[0].numFeatures, *more))
