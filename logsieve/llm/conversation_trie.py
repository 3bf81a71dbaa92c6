"""The trie of conversations' turns, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by the smallest conversation below it and its depth, so a node's parent
is always an earlier one in the order of names. Nodes are dealt by ranges of names into shards. In a shard they are visited from the
deepest level up; a node takes what was sent to it from a priority queue, adds its own and sends the sum to its parent. What is sent
to a node of another shard leaves the shard as one message for each such node; shards that get messages are visited again
until nothing changes, which goes towards earlier shards only.
"""

import heapq
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.work import new_folder, shared_folder, spread_join, stored

#: Messages that a queue holds in memory, turns whose prefixes are added up in one task, ids that one piece of a digest joins.
QUEUE, TURNS, PIECE = 1 << 19, 1 << 12, 1 << 14
KEY = ["depth", "kx", "ky"]


class SpillingQueue:
    """A priority queue of equal-length tuples of integers: sorted runs go to the shared folder when ``limit`` are in memory."""

    def __init__(self, folder: str, limit: int, width: int):
        self._folder, self._limit, self._width = folder, limit, width
        self._heap: list[tuple] = []
        self._heads: list[tuple] = []  # (first record, number, rest) of each run
        self._runs = 0

    def push(self, record: tuple) -> None:
        heapq.heappush(self._heap, record)
        if len(self._heap) >= self._limit:
            system, path = shared_folder(self._folder)
            system.create_dir(path)
            name = f"{path}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                out.write(np.array(sorted(self._heap), "<i8").tobytes())
            self._heap = []
            rest = self._read(system, name)
            self._runs += 1
            heapq.heappush(self._heads, (next(rest), self._runs, rest))

    def _read(self, system, name: str) -> Iterator[tuple]:
        with system.open_input_stream(name) as run:
            while data := run.read(8 * self._width * 4096):
                yield from map(tuple, np.frombuffer(data, "<i8").reshape(-1, self._width).tolist())

    def pop_below(self, bound: tuple | None) -> Iterator[tuple]:
        """All records that sort before ``bound``, in order; all there are without a bound."""
        while self._heap or self._heads:
            own = not self._heads or bool(self._heap) and self._heap[0] <= self._heads[0][0]
            first = self._heap[0] if own else self._heads[0][0]
            if bound is not None and first >= bound:
                return
            if own:
                heapq.heappop(self._heap)
            else:
                _, number, rest = self._heads[0]
                follows = next(rest, None)
                if follows is None:
                    heapq.heappop(self._heads)
                else:
                    heapq.heapreplace(self._heads, (follows, number, rest))
            yield first


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, idx, a, b, size) per turn: its place from 0 in the order of the turn number, null first, and a 120-bit digest of role and text.

    Turns of one number are ordered by their digest. Rows are dealt by range of (conversation, turn), and places are added up over
    ranges, so a conversation may span many tasks. Rows without a conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring("_digest", at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest.alias("_digest"), F.octet_length(text).cast("long").alias("size")
    )
    rows = rows.select("conv", "turn", half(1).alias("a"), half(16).alias("b"), "size")
    dealt = stored(rows.repartitionByRange("conv", "turn", "a", "b").withColumn("range", F.spark_partition_id()), "turns")
    inner = F.row_number().over(Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = dealt.withColumn("inner", inner).join(before, ["conv", "range"])
    return stored(placed.select("conv", (F.col("inner") - 1 + F.col("before")).alias("idx"), "a", "b", "size"), "ordered")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(turns: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's turns: (conv, pos, a, b, size) and (conv, len).

    ``donor`` and ``taken`` are columns over ``conv``: whose first turns, and how many of them (``most`` at the most), stand before what
    comes after as many of its own. A donor that is absent gives none. A donor may serve a bounded number of conversations only.
    """
    known = stored(lengths(turns), "lengths")
    plans = known.select("conv", "n", donor.alias("donor"), taken.cast("long").alias("taken"))
    plans = plans.join(known.select(F.col("conv").alias("donor"), F.col("n").alias("there")), "donor", "left")
    head = F.least("taken", F.coalesce("there", F.lit(0)))
    plans = stored(plans.select("conv", "donor", "taken", head.alias("head"), (head + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("len")), "plans")
    own = spread_join(turns, plans.select("conv", "taken", "head"), "conv").where("idx >= taken")
    own = own.select("conv", (F.col("head") + F.col("idx") - F.col("taken")).alias("pos"), "a", "b", "size")
    first = turns.where(F.col("idx") < most).withColumnRenamed("conv", "donor")
    lent = first.join(plans.select("conv", "donor", "taken"), "donor").where("idx < taken")
    return own.unionByName(lent.select("conv", F.col("idx").alias("pos"), "a", "b", "size")), plans.select("conv", "len")


def _prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, depth, kx, ky, ox, oy, size, ends) per turn: keys of the sequence up to it and of the one before it.

    A sequence's key is the exclusive or of two 64-bit hashes of each (place, turn); it is added up in blocks and over blocks.
    """
    tags = turns.withColumn("x", F.xxhash64("pos", "a", "b")).withColumn("y", F.xxhash64("b", "a", "pos")).withColumn("block", F.floor(F.col("pos") / TURNS))
    tags = stored(tags, "tags")
    up_to = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tags.groupBy("conv", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    before = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("bx", "by")])
    rows = tags.withColumn("wx", F.bit_xor("x").over(up_to)).withColumn("wy", F.bit_xor("y").over(up_to)).join(before, ["conv", "block"])
    keys = {f"k{c}": F.col(f"w{c}").bitwiseXOR(F.col(f"b{c}")) for c in "xy"}
    rows = rows.withColumns(keys).withColumns({f"o{c}": F.col(f"k{c}").bitwiseXOR(F.col(c)) for c in "xy"})
    rows = spread_join(rows.withColumn("depth", F.col("pos") + 1).select("conv", *KEY, "ox", "oy", "size"), sizes, "conv")
    return stored(rows.select("conv", *KEY, "ox", "oy", "size", (F.col("depth") == F.col("len")).alias("ends")), "prefixes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row, some thousand at a time, from rows in order of node and id."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "kx": [key[1]], "ky": [key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv"))):
            if own != key or len(ids) >= PIECE:
                if ids:
                    yield piece()
                key, ids = own, []
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order; one state at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "kx": [key[1]], "ky": [key[2]], "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if own != key:
                if state:
                    yield done()
                key, state = own, sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state:
        yield done()


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): SHA-256 of the ids in order, joined by commas.

    Ids are ordered by range and joined to pieces in many tasks; a digest is sequential by nature, so one task then runs it
    over the node's pieces as a stream.
    """
    order = [*KEY, "conv"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, kx long, ky long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, kx long, ky long, ends_sha256 string")


SENT = "shard int, to_shard int, conv_id long, depth long, children long, leaves long, saved long"


def _visited(bounds: list[tuple[int, int]], shards: list[int], folder: str, limit: int, totals: bool) -> Callable:
    """A pass over shards, given as rows in order of (shard, depth downwards, conv_id): messages of ``kind`` 0, nodes of ``kind`` 1.

    Gives the nodes' totals, or what is sent to nodes of other shards.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard, queue = None, SpillingQueue(folder, limit, 5)

        def leave(records: Iterator[tuple]) -> None:
            """Records of nodes that are not in this shard, added up by node."""
            for level, conv, children, leaves, saved in records:
                if out and out[-1][0] == shard and out[-1][2:4] == [conv, -level]:
                    out[-1][4:] = [out[-1][4] + children, out[-1][5] + leaves, out[-1][6] + saved]
                else:
                    out.append([shard, shards[bisect_right(bounds, (conv, -level)) - 1], conv, -level, children, leaves, saved])

        def rows() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 7
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in SENT.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return batch

        names = ("shard", "kind", "conv_id", "depth", "parent_conv_id", "own_leaf", "own_saved", "children", "leaves", "saved")
        arrived = [0, 0, 0]
        for batch in batches:
            for at, kind, conv, depth, parent, leaf, own, *more in zip(*(batch.column(c).to_pylist() for c in names)):
                if at != shard:
                    rest = queue.pop_below(None)
                    leave(rest) if not totals else [None for _ in rest]
                    shard = at
                if kind == 0:
                    arrived = [x + y for x, y in zip(arrived, more)]
                    continue
                here = (-depth, conv)
                strays = queue.pop_below(here)
                leave(strays) if not totals else [None for _ in strays]
                for record in queue.pop_below((-depth, conv + 1)):
                    arrived = [x + y for x, y in zip(arrived, record[2:])]
                children, leaves, saved = arrived
                leaves, saved, arrived = leaves + leaf, saved + own, [0, 0, 0]
                if depth:
                    queue.push((1 - depth, parent, 1, leaves, saved))
                if totals:
                    out.append([at, at, conv, depth, children, leaves, saved])
                    if len(out) >= 1 << 14:
                        yield rows()
            if len(out) > 1 << 14:  # the last one may still grow
                last = out.pop()
                yield rows()
                out.append(last)
        rest = queue.pop_below(None)
        leave(rest) if not totals else [None for _ in rest]
        yield rows()

    return visit


def subtree_totals(nodes: DataFrame, limit: int = QUEUE) -> DataFrame:
    """(conv_id, depth, children, leaves, saved) of nodes (conv_id, depth, parent_conv_id, own_leaf, own_saved).

    The driver holds each shard's first name and the numbers of shards that got messages, as many as there are partitions.
    """
    spark = nodes.sparkSession
    dealt = stored(nodes.repartitionByRange("conv_id", "depth").withColumn("shard", F.spark_partition_id()), "shards")
    lows = dealt.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("low")).collect()
    lows = sorted((tuple(r.low), r.shard) for r in lows)
    bounds, shards = [low for low, _ in lows], [s for _, s in lows]
    folder = new_folder(spark, "queues")
    none = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]

    def visit(which: list[int] | None, sent: DataFrame | None, totals: bool) -> DataFrame:
        rows = dealt.select("shard", F.lit(1).alias("kind"), "conv_id", "depth", "parent_conv_id", "own_leaf", "own_saved", *none)
        if sent is not None:
            empty = [F.lit(0).cast("long").alias(c) for c in ("own_leaf", "own_saved")]
            summed = sent.groupBy("to_shard", "conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
            rows = rows.unionByName(summed.select(F.col("to_shard").alias("shard"), F.lit(0).alias("kind"), "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), *empty, "children", "leaves", "saved"))
        if which is not None:
            rows = rows.where(F.col("shard").isin(which))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id", "kind")
        return rows.mapInArrow(_visited(bounds, shards, folder, limit, totals), SENT)

    sent = stored(visit(None, None, False), "messages")
    changed = sent
    while which := [r.to_shard for r in changed.select("to_shard").distinct().collect()]:
        again = stored(visit(which, sent, False), "messages")
        changed = again.subtract(sent)
        sent = stored(sent.where(~F.col("shard").isin(which)).unionByName(again), "messages")
    return visit(None, sent, True).select("conv_id", "depth", "children", "leaves", "saved")


def trie(turns: DataFrame, sizes: DataFrame, limit: int = QUEUE) -> DataFrame:
    """One row per node of conversations (conv, pos, a, b, size), of lengths (conv, len), which may be 0.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node whose
    members all end at it is a leaf. Members are counted inside the map tasks first, so a node that all share is no hot spot.
    """
    rows = _prefixes(turns, sizes)
    grouped = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("size").alias("size"),
        F.min("ox").alias("ox"), F.min("oy").alias("oy"),
    )
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("len") == 0).alias("n_ends"))
    root = root.where("n_convs > 0").select(*[zero.alias(c) for c in KEY], "*", zero.alias("size"), *[F.lit(None).cast("long").alias(c) for c in ("ox", "oy")])
    nodes = stored(grouped.unionByName(root), "nodes")
    up = F.when(F.col("depth") > 0, F.struct(F.col("depth") - 1, "ox", "oy").cast("struct<depth:long,kx:long,ky:long>"))
    parents = nodes.select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    nodes = spread_join(nodes.withColumn("up", up), parents, "up", "left")
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long").alias("own_leaf")
    nodes = nodes.select(*KEY, "conv_id", "parent_conv_id", "n_convs", leaf, ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"))
    nodes = stored(nodes, "named-nodes")

    ends = rows.where("ends").select(*KEY, "conv").unionByName(sizes.where("len = 0").select(*[zero.alias(c) for c in KEY], "conv"))
    totals = subtree_totals(nodes.select("conv_id", "depth", "parent_conv_id", "own_leaf", "own_saved"), limit)
    known = nodes.join(digests(ends), KEY, "left").join(totals, ["conv_id", "depth"])
    return known.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, limit: int = QUEUE, **columns: str) -> DataFrame:
    """The trie of conversations as they are; see ``trie`` for the columns.

    A null turn number comes first, a null role or text is empty, rows without a conversation id are left out, repeated rows are turns
    of their own. An empty table gives an empty result, without a root. Other columns are ignored.
    """
    turns = ordered(conversations, **columns)
    return trie(turns.withColumnRenamed("idx", "pos"), lengths(turns).withColumnRenamed("n", "len"), limit)


def shared_openings(conversations: DataFrame, limit: int = QUEUE, **columns: str) -> DataFrame:
    """The trie of conversations of which every five begin alike: the first h turns of conversation c come from c - c % 5, with h the
    checksum of c modulo 9. Odd rows as in ``conversation_trie``."""
    conv = F.col("conv")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return trie(*rebuilt(ordered(conversations, **columns), conv - conv % 5, taken, 8), limit)
