"""Trie of the turns conversations begin with, and totals over its subtrees by time-forward processing.

A node is a sequence of first turns; its key combines the position-dependent hashes of the turns, 128 bits in all, and
its parent's key follows from its own. Within a shard, nodes come in reverse level order (deepest first, sorted
outside memory). A node takes the messages that its children left for it from a priority queue, adds itself and sends
one message on to its parent, which stands later in the same order. The queue holds a bounded number of messages in
memory and spills sorted runs, so a shard of any size runs in bounded memory.

Shards are whole subtrees of at most ``SHARD_ROWS`` turns (or a thousandth of all, if that is more). What lies above
them, nodes that very many turns pass through, is processed after them by the same pass: it starts from the totals of
the shard roots, added up per parent, and runs in bands of levels, so no pass holds more than a band.

Nothing is gathered per conversation or per node: turns are numbered by ranges, long conversations are cut into slices
of ``SLICE`` turns, and the ids that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import whole
from tidewire.session import cut_lineage

SLICE = 4096
SHARD_ROWS = 100_000
QUEUE_ROWS = 100_000
GROUP = 5  # conversations that share a leader
HEADS = 9  # a rebuilt conversation takes fewer turns than this from its leader

NODE = ("depth", "k1", "k2")
EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Smallest tuple first; at most ``limit`` in memory, the rest in sorted runs in files of this task alone."""

    def __init__(self, limit: int = QUEUE_ROWS, runs: int = 32):
        self.limit, self.max_runs = limit, runs
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.made = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            self._add(self.heap)
            self.heap = []
            if len(self.runs) > self.max_runs:
                old, self.runs = self.runs, []
                self._add(heapq.merge(*(self._whole(r) for r in old)))

    def _whole(self, run: tuple[tuple, int, Iterator[tuple]]) -> Iterator[tuple]:
        yield run[0]
        yield from run[2]

    def _add(self, items: Iterable[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for item in items:
            pickle.dump(item, file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self._advance(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def _advance(self, rest: Iterator[tuple]) -> None:
        head = next(rest, None)
        if head is not None:
            self.made += 1
            heapq.heappush(self.runs, (head, self.made, rest))

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, _, rest = heapq.heappop(self.runs)
            self._advance(rest)
            return head
        return heapq.heappop(self.heap)


def time_forward(rows: Iterable[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Totals of nodes that come in reverse level order: rows of STREAM in, rows of DONE out.

    A row of kind 0 brings children, leaves and saved tokens from outside to the node of its key, which follows it. A
    node that stops, and the root, are given out open, without a parent; all others when their parent is reached.
    """
    key = None
    for depth, k1, k2, kind, p1, p2, conv_id, n_convs, n_bytes, ends, stop, n_children, n_leaves, n_saved in rows:
        if key != (-depth, k1, k2):
            key, children, leaves, saved = (-depth, k1, k2), 0, 0, 0
        if kind == 0:
            children, leaves, saved = children + n_children, leaves + n_leaves, saved + n_saved
            continue
        while (top := queue.first()) is not None and top[:3] == key:
            child = queue.pop()[3:]
            children, leaves, saved = children + 1, leaves + child[8], saved + child[9]
            yield (*child, conv_id, False)
        record = (depth, k1, k2, p1, p2, conv_id, n_convs, children, leaves if children else 1, saved + (n_convs - 1) * n_bytes, ends)
        if stop or depth == 0:
            yield (*record, None, True)
        else:
            queue.push((1 - depth, p1, p2, *record))


STREAM = ("depth", "k1", "k2", "kind", "p1", "p2", "conv_id", "n_convs", "n_bytes", "ends", "stop", "n_children", "n_leaves", "n_saved")
DONE = ("depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "n_saved bigint, ends string, parent_conv_id bigint, open boolean")


def forwarded(stream: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``time_forward`` over each partition of STREAM rows, in reverse level order there."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DONE.split(", ")]
        kinds = [pa.int64()] * 10 + [pa.string(), pa.int64(), pa.bool_()]
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*held), kinds)], names=names)

        for row in time_forward(rows, SpillingQueue(queue_rows)):
            held.append(row)
            if len(held) == 20_000:
                yield out()
                held.clear()
        if held:
            yield out()

    ordered = stream.select(*STREAM).sortWithinPartitions(F.desc("depth"), "k1", "k2", "kind")
    return ordered.mapInArrow(of, DONE)


def sliced(rows: DataFrame, place: str) -> DataFrame:
    return rows.withColumn("slice", F.expr(f"{place} div {SLICE}"))


def ordered_turns(conversations: DataFrame, rows_per_part: int = SHARD_ROWS) -> DataFrame:
    """(conv_id, pos, role, digest, n_bytes): turns numbered from 0, by ranges of all turns, so a conversation may span many.

    Turns are in order of turn (null first), then role, then MD5 of the text. Null role or text is empty. Rows without
    a conv_id belong to no conversation and are left out; equal rows are turns of their own.
    """
    rows = cut_lineage(conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), whole("role").alias("role"),
        F.md5(whole().cast("binary")).alias("digest"), F.octet_length(whole()).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("tie")))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("tie")]
    parts = max(1, -(-rows.count() // rows_per_part))
    ranged = cut_lineage(rows.repartitionByRange(parts, F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n")).select(
        "part", "conv_id", F.sum("n").over(earlier).alias("offset")).filter("offset > 0")  # at most one per part
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("inside") + F.coalesce("offset", F.lit(0))).alias("pos"), "role", "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt length, rebuilt turns with their depth from 1)."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({
        "leader": F.col("conv_id") - F.col("conv_id") % GROUP,
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    leaders = own.select(F.col("conv_id").alias("leader"), F.col("own").alias("led"))
    convs = cut_lineage(own.join(leaders, "leader", "left").withColumn("kept", F.least("h", F.coalesce("led", F.lit(0)))).select(
        "conv_id", "leader", "own", "h", "kept", (F.col("kept") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")))
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "leader").join(
        convs, "leader").filter("pos < h").withColumn("depth", F.col("pos") + 1)
    spread = convs.withColumn("slice", F.explode(F.expr(f"sequence(0L, (own - 1) div {SLICE})")))
    tails = sliced(turns, "pos").join(spread, ["conv_id", "slice"]).filter("pos >= h").withColumn(
        "depth", F.col("kept") + F.col("pos") - F.col("h") + 1)
    columns = ["conv_id", "depth", "length", "role", "digest", "n_bytes"]
    return convs, heads.select(columns).unionByName(tails.select(columns))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, n_bytes, k1, k2, p1, p2): the node of each rebuilt turn and its parent."""
    hashed = sliced(turns.withColumns({
        "e1": F.xxhash64("depth", "role", "digest"), "e2": F.xxhash64(F.lit("second"), "digest", "depth", "role")}), "(depth - 1)")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = hashed.groupBy("conv_id", "slice").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2")).select(
        "conv_id", "slice", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2")).filter("slice > 0")
    so_far = Window.partitionBy("conv_id", "slice").orderBy("depth")

    def key(n: int) -> Column:
        return F.coalesce(F.col(f"c{n}"), F.lit(0)).bitwiseXOR(F.bit_xor(f"e{n}").over(so_far))

    joined = hashed.join(carried, ["conv_id", "slice"], "left").withColumns({"k1": key(1), "k2": key(2)})
    return joined.select("conv_id", "depth", "length", "n_bytes", "k1", "k2",
                         F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"))


def ended(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the ids that end at a node, hashed as they pass in numeric order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, held = None, None, []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([h[i] for h in held], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                   names=[*NODE, "ends"])

        for batch in batches:
            for *here, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if here != key:
                    if key is not None:
                        held.append((*key, digest.hexdigest()))
                    key, digest = here, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(b",%d" % conv_id)
            if len(held) > 10_000:
                yield out()
                held = []
        if key is not None:
            held.append((*key, digest.hexdigest()))
        yield out()

    zero = F.lit(0).cast("long")
    last = path.filter("depth = length").select(*NODE, "conv_id").unionByName(
        convs.filter("length = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    return last.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(of, "depth bigint, k1 bigint, k2 bigint, ends string")


def marked_nodes(path: DataFrame, convs: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes in shards, with s1, s2 of their shard's root and whether they are it; nodes above the shards)."""
    nodes = path.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in NODE), "n_convs", "conv_id", *(zero.alias(c) for c in ("n_bytes", "p1", "p2")),
        F.lit(1 << 62).alias("weight"))
    every = cut_lineage(nodes.unionByName(root).join(ended(path, convs), list(NODE), "left").fillna(EMPTY, ["ends"]))
    heavy = cut_lineage(every.filter(F.col("weight") > shard_rows))
    # the first node of a conversation that is not heavy is the root of its shard
    light = path.join(heavy.select(*NODE), list(NODE), "left_anti")
    tops = light.groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("top"), F.max("length").alias("length"))
    tops = tops.select("conv_id", F.col("top.depth").alias("s0"), F.col("top.k1").alias("s1"), F.col("top.k2").alias("s2"),
                       F.explode(F.expr(f"sequence((top.depth - 1) div {SLICE}, (length - 1) div {SLICE})")).alias("slice"))
    small = sliced(every.filter(F.col("weight") <= shard_rows), "(depth - 1)").join(tops, ["conv_id", "slice"])
    same = (F.col("depth") == F.col("s0")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    return small.withColumn("stop", same), heavy


def as_stream(nodes: DataFrame, *more: str) -> DataFrame:
    none = F.lit(0).cast("long")
    return nodes.select(*NODE, F.lit(1).alias("kind"), "p1", "p2", "conv_id", "n_convs", "n_bytes", "ends", "stop",
                        none.alias("n_children"), none.alias("n_leaves"), none.alias("n_saved"), *more)


def messages(done: DataFrame) -> DataFrame:
    """What open nodes tell their parents, one row per parent."""
    empty = [F.lit(None).cast("long").alias(c) for c in ("p1", "p2", "conv_id", "n_convs", "n_bytes")]
    return done.filter("open and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("n_saved").alias("n_saved")).select(
        *NODE, F.lit(0).alias("kind"), *empty, F.lit(None).cast("string").alias("ends"), F.lit(False).alias("stop"),
        "n_children", "n_leaves", "n_saved")


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; no conversations, no rows. Extra columns are ignored."""
    convs, turns = rebuilt(cut_lineage(ordered_turns(conversations, shard_rows)))
    path = cut_lineage(paths(turns))
    total = path.count()
    limit = max(shard_rows, total // 1000)
    small, heavy = marked_nodes(path, convs, limit)
    parts = max(1, -(-total // limit))
    done = [cut_lineage(forwarded(as_stream(small, "s0", "s1", "s2").repartition(parts, "s0", "s1", "s2"), queue_rows))]
    size, deepest = heavy.agg(F.count("*"), F.max("depth")).first()
    if size:
        band = max(1, min(deepest + 1, (deepest + 1) * limit // size))
        top = deepest
        while top >= 0:
            low = max(0, top - band + 1)
            here = heavy.filter(F.col("depth").between(low, top)).withColumn("stop", F.col("depth") == low)
            told = messages(done[0] if len(done) == 1 else done[0].unionByName(done[-1])).filter(F.col("depth").between(low, top))
            done.append(cut_lineage(forwarded(as_stream(here).unionByName(told).repartition(1), queue_rows)))
            top = low - 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    return every.join(above, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("n_saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op11_conversation_prefix_trie(conversations: DataFrame) -> DataFrame:
    return trie(conversations)


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS leader,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda a, b: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM turns GROUP BY conv_id
), convs AS (
  SELECT a.conv_id, a.leader, a.h, least(a.h, coalesce(b.own, 0)) AS kept, least(a.h, coalesce(b.own, 0)) + greatest(0, a.own - a.h) AS length
  FROM own a LEFT JOIN own b ON b.conv_id = a.leader
), built AS (
  SELECT c.conv_id, pos + 1 AS depth, length, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.leader AND pos < h
  UNION ALL SELECT c.conv_id, kept + pos - h + 1, length, said, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h
), keyed AS (
  SELECT conv_id, depth, length, bytes, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM built
), paths AS (
  SELECT conv_id, depth, length, bytes, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS above FROM keyed
  UNION ALL SELECT conv_id, 0, length, 0, 'root', NULL FROM convs
), nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '') AS ends
  FROM paths GROUP BY node, depth
), children AS (SELECT above, count(*) AS n FROM nodes GROUP BY above
), sums AS (
  SELECT p.node, p.depth, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.above = n.node GROUP BY p.node, p.depth
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth LEFT JOIN children c ON c.above = n.node LEFT JOIN nodes up ON up.node = n.above
"""
