"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share many bits. Each run of ``FAN`` neighbours is a node that holds
the bits all its members share (mask and pattern); runs of nodes form upper nodes in the same way. A self-join walks
pairs of nodes downwards and adds up differences on shared bits: once they pass the radius, two whole groups are out.

Work is dealt out by pigeonhole: fingerprints within ``radius`` bits agree on one of ``radius + 1`` blocks of bits, so
each fingerprint goes to one group per block. A group with too many members is dealt again by blocks of its remaining
bits, which keeps the join exact at every depth. A task returns each member's lowest linked member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import whole
from tidewire.operators.graph import connected_components
from tidewire.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
FAN = 16
GROUP_LIMIT = 20_000
TASK_ROWS = 400_000
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(run), SEED) for run in runs], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, kh, fp): kh is a hash of the text, fp the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "kh", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("kh"), whole().alias("text"))
    return source.mapInArrow(of, "doc_id bigint, kh bigint, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (first, last, mask, pattern) over fingerprints sorted by (group, Gray rank); nodes never cross groups."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), groups))
        self.codes, groups = codes[self.order], groups[self.order]
        n = len(codes)
        full = np.full(n, ~np.uint64(0))
        self.levels = [(np.arange(n), np.arange(1, n + 1), full, self.codes)]
        while True:
            first, last, mask, pattern = self.levels[-1]
            count = len(first)
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if count else np.zeros(0, np.int64)
            if len(starts) == count:
                break
            inside = np.arange(count) - np.repeat(starts, np.diff(np.r_[starts, count]))
            heads = np.flatnonzero(inside % FAN == 0)
            all_on = np.bitwise_and.reduceat(pattern | ~mask, heads)
            all_off = np.bitwise_and.reduceat(~pattern | ~mask, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & (all_on | all_off)
            self.levels.append((heads, np.r_[heads[1:], count], shared, all_on & shared))
            groups = groups[heads]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions in sorted order within ``radius`` bits, in bounded blocks."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        waiting = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        while waiting:
            level, a, b, passed = waiting.pop()
            if level == 0:
                other = a != b
                yield a[other], b[other]
                continue
            first, last, mask, _ = self.levels[level]
            _, _, low_mask, low = self.levels[level - 1]
            wide = (last[a] - first[a]) * (last[b] - first[b])
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(wide) // PAIRS_AT_ONCE)) + 1):
                pa_, pb, w = a[part], b[part], wide[part]
                pair = np.repeat(np.arange(len(part)), w)
                step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                across = (last[pb] - first[pb])[pair]
                x, y = first[pa_][pair] + step // across, first[pb][pair] + step % across
                keep = x <= y
                x, y, pair = x[keep], y[keep], pair[keep]
                seen = (mask[pa_] & mask[pb])[pair]  # differences on these bits are counted already
                fresh = np.bitwise_count((low[x] ^ low[y]) & low_mask[x] & low_mask[y] & ~seen)
                total = passed[part][pair] + fresh
                near = total <= radius
                if near.any():
                    waiting.append((level - 1, x[near], y[near], total[near]))

    def heads(self, radius: int) -> np.ndarray:
        """For each input code the lowest position (in sorted order) it reaches over links."""
        label = np.arange(len(self.codes))
        for a, b in self.links(radius):
            while len(a):
                la, lb = label[a], label[b]
                apart = la != lb
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label != label[label]).any():
                    label = label[label]
        return label


def linked(codes: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, lowest-placed code it reaches) for every code that does not lead itself."""
    index = GrayIndex(codes, groups)
    label = index.heads(radius)
    moved = label != np.arange(len(label))
    return index.codes[moved], index.codes[label[moved]]


def _split(mask: int, blocks: int) -> list[int]:
    """``mask`` widened by each of ``blocks`` runs of the bits it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in run) for run in np.array_split(free, blocks)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_edges(codes: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) edges that span the links of the distinct fingerprints in column fp."""
    blocks = radius + 1
    masks = _split(0, blocks)
    level = codes.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
    level = level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    dealt = None
    while True:
        deeper = {m: _split(m, blocks) for m in masks if bin(m).count("1") <= 64 - blocks}
        crowded = level.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > group_limit)
        crowded = cut_lineage(crowded.filter(F.col("mask").isin([_signed(m) for m in deeper])))
        if crowded.isEmpty():
            dealt = level if dealt is None else dealt.unionByName(level)
            break
        calm = level.join(crowded, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        dealt = calm if dealt is None else dealt.unionByName(calm)
        finer = F.create_map(*(x for m, fine in deeper.items() for x in (
            F.lit(_signed(m)).cast("long"), F.array(*(F.lit(_signed(f)).cast("long") for f in fine)))))
        level = level.join(crowded, ["mask", "value"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        level = cut_lineage(level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))
        masks = sorted({f for fine in deeper.values() for f in fine})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            got = np.stack([batch.column(c).to_numpy() for c in range(3)])
            new = np.flatnonzero((got[:2, 1:] != got[:2, :-1]).any(axis=0)) + 1
            if rows >= TASK_ROWS and (len(new) or (held[-1][:2, -1] != got[:2, 0]).any()):
                cut = 0 if (held[-1][:2, -1] != got[:2, 0]).any() else new[0]  # flush at a border between groups
                yield flush([*held, got[:, :cut]])
                held, rows, got = [], 0, got[:, cut:]
            if got.shape[1]:
                held.append(got)
                rows += got.shape[1]
        if held:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        got = np.concatenate(held, axis=1)
        groups = np.cumsum(np.r_[0, (got[:2, 1:] != got[:2, :-1]).any(axis=0)])
        a, b = linked(np.ascontiguousarray(got[2]).view(np.uint64), groups, radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    grouped = dealt.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return grouped.mapInArrow(join, "a bigint, b bigint")


def components(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, kh, fp, root, component_id): root is a fingerprint that stands for the component, component_id the smallest doc_id reachable over links of at most ``radius`` bits.

    Equal fingerprints are folded before anything is compared. Null, empty and blank texts have fingerprint 0 and link
    like any other. Repeated rows each get the same result. A component whose ids are all null has a null id. Extra
    columns are ignored; an empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, size))
    codes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    edges = cut_lineage(near_edges(codes, radius, group_limit).distinct())
    if not edges.isEmpty():
        joined = connected_components(edges).select(F.col("id").alias("fp"), "component")
        rooted = codes.join(joined, "fp", "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        codes = rooted.join(least, "root").select("fp", "root", "component_id")
    else:
        codes = codes.select("fp", F.col("fp").alias("root"), F.col("first_doc").alias("component_id"))
    return marked.join(codes, "fp").select("doc_id", "kh", "fp", "root", "component_id")


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Whole rows of ``docs``, one per root in ``found`` (doc_id, kh, root): that of the smallest doc_id (then hash of the text; null ids last)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "kh")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.kh").alias("first_kh"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(whole()).alias("kh"))  # names in docs may clash
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("kh") == F.col("first_kh")), "left_semi").select("row.*")
    all_once = found.groupBy("doc_id", "kh").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return kept if all_once else kept.dropDuplicates(["doc_id", "text"])


def op9_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
