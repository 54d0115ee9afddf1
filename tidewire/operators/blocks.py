"""Exact similarity self-joins of sparse rows, block against block.

Rows are dealt to blocks and every two blocks meet in one cell. A cell indexes one block in memory and streams the other
past it, and only pairs that reach the threshold leave it. What is shuffled is each row once per block, however many
pairs share a frequent term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import cut_lineage, drop_shuffles, settled

# Entries of one block, and the fewest blocks.
BLOCK = 20_000_000
FEWEST = 4
# Rows of one block: a task goes over them for every row that meets frequent terms.
ROWS = 200_000
# Entries that one pass over the blocks shuffles, all copies of the rows together; one copy per side at least.
AT_ONCE = 64_000_000
# The rest of a row that is not looked up may add this share of what a pair needs.
SHARE = 0.7
EPS = 1e-9


def codes(terms: Column) -> Column:
    """64-bit hashes that stand for the terms."""
    return F.transform(terms, lambda w: F.xxhash64(w))


class _Lists:
    """Rows of a batch as flat arrays: ``at[i]:at[i + 1]`` are the entries of row i."""

    def __init__(self, batches: list[pa.RecordBatch], weighted: bool):
        table = pa.Table.from_batches(batches)
        self.ids = table.column("id").combine_chunks()
        lists = table.column("codes").combine_chunks()
        self.at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.codes = lists.flatten().to_numpy(zero_copy_only=False)
        self.weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False) if weighted else np.ones(len(self.codes))
        self.n = len(self.ids)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class _Index:
    def __init__(self, rows: _Lists, t: float, cosine: bool):
        self.rows, self.t, self.cosine = rows, t, cosine
        self.vocabulary, local = np.unique(rows.codes, return_inverse=True)
        self.local = local.astype(np.int32)
        self.df = np.bincount(self.local, minlength=len(self.vocabulary))
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        order = np.argsort(self.local, kind="stable")
        owner = np.repeat(np.arange(rows.n, dtype=np.int32), np.diff(rows.at))
        self.owner, self.weight = owner[order], rows.weights[order]
        self.sizes = np.diff(rows.at)
        self.dense = np.zeros(len(self.vocabulary))

    def matches(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose similarity with the given one reaches the threshold, and the similarities."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(self.vocabulary):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        here = self.vocabulary[at] == codes
        at, w = at[here], weights[here]
        # entries rarest first; the common rest cannot add more than its length (cosine) or number (sets)
        order = np.argsort(self.df[at], kind="stable")
        at, w = at[order], w[order]
        least = self.t if self.cosine else self.t * len(codes)
        left = np.append(np.cumsum((w * w)[::-1])[::-1], 0.0)
        if self.cosine:
            left = np.sqrt(left)
        if left[0] < least - EPS:
            return none
        head = int(np.argmax(left < least * SHARE))
        rest = left[head]
        hot = at[:head]
        spots = _ranges(self.first[hot], self.df[hot])
        if not len(spots):
            return none
        owner, worth = self.owner[spots], self.weight[spots] * np.repeat(w[:head], self.df[hot])
        if len(owner) * 8 < self.rows.n:
            hit, owner = np.unique(owner, return_inverse=True)
            part, sizes = np.bincount(owner, weights=worth), self.sizes[hit]
        else:
            hit, part, sizes = None, np.bincount(owner, weights=worth, minlength=self.rows.n), self.sizes
        need = self.t if self.cosine else (sizes + len(codes)) * (self.t / (1 + self.t))
        found = np.flatnonzero((part > 0) & (part + rest >= need - EPS))
        if hit is not None:
            found = hit[found]
        if not len(found):
            return none
        # whole products of what is left
        self.dense[at] = w
        sizes = self.sizes[found]
        spots = _ranges(self.rows.at[found], sizes)
        dots = np.add.reduceat(self.dense[self.local[spots]] * self.rows.weights[spots], np.cumsum(sizes) - sizes)
        self.dense[at] = 0.0
        score = dots if self.cosine else dots / (sizes + len(codes) - dots)
        kept = score >= self.t - EPS
        return found[kept], score[kept]


def _meet(batches: Iterator[pa.RecordBatch], t: float, cosine: bool, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows arrive by cell, those to be indexed (side 0) first. A cell of one block compares that with itself."""
    cell, waiting, index = None, [], None

    def compared(index: _Index, rows: _Lists, own: bool) -> Iterator[pa.RecordBatch]:
        left, right, scores, held = [], [], [], 0
        for i in range(rows.n):
            lo, hi = rows.at[i], rows.at[i + 1]
            found, score = index.matches(rows.codes[lo:hi], rows.weights[lo:hi])
            if own:
                later = found > i
                found, score = found[later], score[later]
            if len(found):
                left.append(np.full(len(found), i)), right.append(found), scores.append(score)
                held += len(found)
            if held > 100_000 or (held and i == rows.n - 1):
                x, y = rows.ids.take(pa.array(np.concatenate(left))), index.rows.ids.take(pa.array(np.concatenate(right)))
                yield pa.RecordBatch.from_arrays([x, y, pa.array(np.concatenate(scores))], schema=fields)
                left, right, scores, held = [], [], [], 0

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal index
        if waiting:
            index = _Index(_Lists(waiting, cosine), t, cosine)
            waiting.clear()
            if cell[0] == cell[1]:
                yield from compared(index, index.rows, True)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "side")])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            x, y, side = (int(k) for k in keys[:, lo])
            if (x, y) != cell:
                yield from closed()
                cell, index = (x, y), None
            part = batch.slice(lo, hi - lo)
            if side == 0:
                waiting.append(part)
            else:
                yield from closed()
                if index is not None:
                    yield from compared(index, _Lists([part], cosine), False)
    yield from closed()


def passes(n: int, entries: int) -> list[list[int]]:
    """The distances (0 to n / 2, the blocks in a ring) at which blocks meet in each pass, so that a pass shuffles about ``AT_ONCE`` entries."""
    out, held = [], 0
    for d in range(n // 2 + 1):
        copies = entries if d == 0 or 2 * d == n else 2 * entries
        if not out or held + copies > AT_ONCE:
            out.append([])
            held = 0
        out[-1].append(d)
        held += copies
    return out


def partners(block: Column, n: int, distances: list[int]) -> Column:
    """The blocks that ``block`` meets at these distances."""
    return F.array_distinct(F.array(*(F.pmod(block + F.lit(d), F.lit(n)) for d in distances), *(F.pmod(block - F.lit(d), F.lit(n)) for d in distances)))


def in_passes(spark: SparkSession, distances: list[list[int]], meet: Callable[[list[int]], DataFrame]) -> DataFrame:
    """What ``meet`` gives for all distances. With several passes each is written and its shuffle let go before the next."""
    if len(distances) == 1:
        return meet(distances[0])
    found = None
    for some in distances:
        part = settled(meet(some))
        found = part if found is None else found.unionByName(part)
        drop_shuffles(spark)
    return found


def similar(rows: DataFrame, t: float, cosine: bool, scope: str | None = None, each: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """(a, b, similarity), each pair once: rows (id, codes, and weights of unit length if ``cosine``) of cosine or Jaccard ``t`` or more.

    ``codes`` are distinct within a row and weights are not negative. Rows that differ in the column ``scope`` share no
    code: they are dealt to buckets by it, and only large buckets are cut into blocks. Large inputs meet in several passes;
    ``each`` says what is kept of the pairs of a pass.
    """
    columns = ["id", "codes"] + (["weights"] if cosine else [])
    rows = rows.filter(F.size("codes") > 0)
    buckets = 1
    if scope is not None:
        buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (ROWS // 2)))
    bucket = F.pmod(F.xxhash64(scope), F.lit(buckets)) if scope is not None else F.lit(0).cast("bigint")
    rows = rows.select(bucket.alias("bucket"), *columns)
    blocks = F.greatest(F.ceil(F.sum(F.size("codes").cast("bigint")) / BLOCK), F.ceil(F.count("*") / ROWS), F.lit(FEWEST if scope is None else 1))
    sizes = cut_lineage(rows.groupBy("bucket").agg(blocks.cast("bigint").alias("n"), F.sum(F.size("codes").cast("bigint")).alias("entries")))
    cut = sizes.collect()  # one row per bucket
    cells = 2 * sum(r.n * (r.n + 1) for r in cut)
    dealt = rows.join(F.broadcast(sizes.select("bucket", "n")), "bucket").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")))
    if scope is None and cut:
        n = cut[0].n
        return in_passes(rows.sparkSession, passes(n, cut[0].entries), lambda some: each(_met(
            dealt, F.explode(partners(F.col("block"), n, some)), columns, cells, t, cosine)))
    return each(_met(dealt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)), columns, cells, t, cosine))


def _met(dealt: DataFrame, other: Column, columns: list[str], cells: int, t: float, cosine: bool) -> DataFrame:
    # two blocks meet once, either of them indexed about as often
    met = dealt.select("*", other.alias("other")).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    turned = (F.col("low") + F.col("high")) % 2 == 1
    first, second = F.when(turned, F.col("high")).otherwise(F.col("low")), F.when(turned, F.col("low")).otherwise(F.col("high"))
    wide = F.col("bucket") * 1_000_000
    met = met.select((wide + first).alias("x"), (wide + second).alias("y"), F.when(F.col("block") == first, 0).otherwise(1).alias("side"), *columns)
    placed = met.repartition(max(cells, 1), "x", "y").sortWithinPartitions("x", "y", "side")
    return _compared(placed, t, cosine)


def between(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of rows (id, codes) of ``left`` and of ``right`` with Jaccard ``t`` or more. No row meets its own side."""
    x, y = (max(2, _blocks(side)) for side in (left, right))
    here = left.filter(F.size("codes") > 0).select(
        F.pmod(F.xxhash64("id"), F.lit(x)).cast("int").alias("x"), F.explode(F.sequence(F.lit(-y), F.lit(-1))).alias("y"), F.lit(0).alias("side"), "id", "codes")
    there = right.filter(F.size("codes") > 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(x - 1))).alias("x"), (-1 - F.pmod(F.xxhash64("id"), F.lit(y))).cast("int").alias("y"), F.lit(1).alias("side"), "id", "codes")
    placed = here.unionByName(there).repartition(4 * x * y, "x", "y").sortWithinPartitions("x", "y", "side")
    return _compared(placed, t, False).select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")


def _blocks(rows: DataFrame) -> int:
    entries, count = rows.agg(F.coalesce(F.sum(F.size("codes").cast("bigint")), F.lit(0)), F.count("*")).first()
    return max(-(-entries // BLOCK), -(-count // ROWS))


def _compared(placed: DataFrame, t: float, cosine: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = placed.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meet(batches, t, cosine, fields)

    return placed.mapInArrow(run, schema)
