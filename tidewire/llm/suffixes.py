"""Suffix-array dedup: every byte covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus goes.

Suffix arrays of all texts would mostly sort text that repeats nowhere, so texts are first cut where equal content is
cut alike. Each window of ``LENGTH`` bytes picks an anchor of ``ANCHOR`` bytes inside itself by its content alone (its
smallest hashed ``SEED_BYTES`` bytes, taken modulo the number of places); neighbouring windows with one anchor form a run.
Equal windows have equal anchors, hence:

1. Runs are dealt out by anchor. An anchor that occurs once holds no repeat. Of runs with the same content only the
   first stays open, the rest are repeats as a whole. Tasks fold equal runs before the shuffle, so a passage in a third
   of all documents sends one run per task.
2. Open runs that share an anchor but differ in content are fetched and sorted in shards: a Larsson-Sadakane suffix
   array, Kasai's common prefixes, and the first place of each class of suffixes that agree on ``LENGTH`` bytes.
3. An anchor with more than ``SHARD_RUNS`` open runs is spread over several shards; each gives its sorted distinct
   windows, and these are merged by binary search of every shard's windows in the others of the same hash range.
4. Repeats come back per document and are cut out of its bytes.

All hashes only deal work out or compare runs under one anchor; a repeat is decided on bytes in step 2, and in step 1 on
equal anchor and content hashes (128 bits together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import whole
from tidewire.session import scratch_path

LENGTH = 100
ANCHOR = 60
SEED_BYTES = 19  # ANCHOR modulo the number of anchor places, plus a floor; see the sampling rule above
PLACES = LENGTH - ANCHOR + 1
SEEDS = LENGTH - SEED_BYTES + 1
BLOCK_BYTES = 8 << 20
FOLD_RUNS = 1_000_000
SHARD_BYTES = 4 << 20
SHARD_RUNS = 50_000
NO_ID = -(1 << 63)

_RUN = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("kd", pa.int64()), ("kh", pa.int64()), ("at", pa.int64()), ("repeat", pa.bool_())])
_RUN_DDL = "key bigint, content bigint, kd bigint, kh bigint, at bigint, repeat boolean"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: list[list[np.ndarray]] = []


def _scales(n: int) -> list[list[np.ndarray]]:
    """Powers of each base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        n = max(n, 1 << 17)
        _powers[:] = [
            [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
            for base in _BASES]
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash, content hash) of the runs of one text of at most ``BLOCK_BYTES`` bytes."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    (up, down), (up2, down2) = _scales(n + 1)
    wide = raw.astype(np.uint64) + np.uint64(1)
    total = np.r_[np.uint64(0), np.cumsum(wide * up[:n], dtype=np.uint64)]
    total2 = np.r_[np.uint64(0), np.cumsum(wide * up2[:n], dtype=np.uint64)]
    seeds = n - SEED_BYTES + 1
    low = _mix((total[SEED_BYTES:] - total[:seeds]) * down[:seeds])
    low = (low & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(seeds, dtype=np.uint64)  # smallest hash, leftmost of equals
    step = 1
    while step * 2 <= SEEDS:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    windows = n - LENGTH + 1
    low = np.minimum(low[:windows], low[SEEDS - step:SEEDS - step + windows])
    first = np.arange(windows)
    anchor = first + ((low & np.uint64(0xFFFFFF)).astype(np.int64) - first) % PLACES
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    s0, s1 = np.r_[0, cut], np.r_[cut, windows] - 1
    a = anchor[s0]
    key = _mix((total[a + ANCHOR] - total[a]) * down[a])
    content = _mix((total2[s1 + LENGTH] - total2[s0]) * down2[s0] + (s1 - s0).astype(np.uint64) * up2[1] + (a - s0).astype(np.uint64) * up[1])
    return s0, s1, key, content


def text_runs(raw: np.ndarray) -> list[np.ndarray]:
    """Runs of a text of any length; blocks overlap by a window less a byte."""
    parts = []
    for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK_BYTES):
        s0, s1, key, content = runs_of(raw[at:at + BLOCK_BYTES + LENGTH - 1])
        parts.append((s0 + at, s1 + at, key, content))
    return [np.concatenate(p) for p in zip(*parts)]


def _packed(s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    return s0 << 32 | s1


def _table(key, content, kd, kh, at, repeat) -> pa.RecordBatch:
    signed = [np.ascontiguousarray(c).view(np.int64) for c in (key, content, kd, kh, at)]
    return pa.record_batch([*map(pa.array, signed), pa.array(repeat)], schema=_RUN)


def _joined(kd: np.ndarray, kh: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of windows merged where they touch."""
    order = np.lexsort((s0, kh, kd))
    kd, kh, s0, s1 = kd[order], kh[order], s0[order], s1[order]
    new = np.r_[True, (kd[1:] != kd[:-1]) | (kh[1:] != kh[:-1]) | (s0[1:] > s1[:-1] + 1)] if len(kd) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return kd[heads], kh[heads], s0[heads], np.maximum.reduceat(s1, heads) if len(heads) else s1


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kd, kh, text) -> runs, with equal runs met in one stretch of the input folded to the first."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def fold() -> Iterator[pa.RecordBatch]:
        s0, s1, key, content, kd, kh = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((s0, kh, kd, content, key))
        s0, s1, key, content, kd, kh = (c[order] for c in (s0, s1, key, content, kd, kh))
        again = np.r_[False, (key[1:] == key[:-1]) & (content[1:] == content[:-1])]
        fresh = ~again
        yield _table(key[fresh], content[fresh], kd[fresh], kh[fresh], _packed(s0, s1)[fresh], np.zeros(fresh.sum(), bool))
        rkd, rkh, r0, r1 = _joined(kd[again], kh[again], s0[again], s1[again])
        if len(rkd):
            spread = _mix(rkd.view(np.uint64) ^ _mix(r0.view(np.uint64)))
            yield _table(spread, np.zeros(len(rkd), np.int64), rkd, rkh, _packed(r0, r1), np.ones(len(rkd), bool))

    for batch in batches:
        for kd, kh, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s0, s1, key, content = text_runs(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8))
            if len(s0):
                held.append((s0, s1, key, content, np.full(len(s0), kd, np.int64), np.full(len(s0), kh, np.int64)))
                count += len(s0)
            if count >= FOLD_RUNS:
                yield from fold()
                held, count = [], 0
    if held:
        yield from fold()


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int, weight, limit: int) -> Iterator[pa.Table]:
    """Sorted batches regrouped into tables that end where the first ``keys`` columns change, once ``limit`` is reached."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size >= limit:
            last = [held[-1].column(c)[-1].as_py() for c in range(keys)]
            same = np.ones(batch.num_rows, bool)
            for c in range(keys):
                same &= batch.column(c).to_numpy(zero_copy_only=False) == last[c]
            border = batch.num_rows if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, border))
            if border < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            batch = batch.slice(border)
        if batch.num_rows:
            held.append(batch)
            size += weight(batch)
    if held:
        yield pa.Table.from_batches(held)


def settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by key, content, document and place -> repeats, and open runs where an anchor has several contents."""
    for table in _whole_keys(batches, 1, lambda b: b.num_rows, FOLD_RUNS):
        key, content, kd, kh, at = (table.column(c).to_numpy() for c in range(5))
        repeat = table.column(5).to_numpy()
        new_key = np.r_[True, key[1:] != key[:-1]]
        again = np.r_[False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]) & ~repeat[1:] & ~repeat[:-1]]
        fresh = ~again & ~repeat
        group = np.cumsum(new_key) - 1
        open_ = fresh & (np.bincount(group, fresh)[group] > 1)
        done = again | repeat
        dkd, dkh, d0, d1 = _joined(kd[done], kh[done], at[done] >> 32, at[done] & 0xFFFFFFFF)
        yield _table(np.zeros(len(dkd), np.int64), np.zeros(len(dkd), np.int64), dkd, dkh, _packed(d0, d1), np.ones(len(dkd), bool))
        yield _table(key[open_], content[open_], kd[open_], kh[open_], at[open_], np.zeros(open_.sum(), bool))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by Larsson and Sadakane: only groups still tied are sorted again, by the rank h places on."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(7, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    key, rank = key[order], np.empty(n, np.int64)
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    tied = np.flatnonzero(np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n])))
    h = 7
    while len(tied):
        some = order[tied]
        ahead = some + h
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[tied] = some
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(key)])
        rank[some] = np.repeat(tied[first], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order, up to ``cap`` and to the end of its piece.

    Kasai carries the prefix length from one suffix of a text to the next, less one; all pieces advance side by side.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    limit = np.repeat(ends, ends - starts) - np.arange(n)
    out = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    offset = 0
    while len(live):
        i = starts[live] + offset
        r = place[i]
        before = order[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(np.minimum(limit[i], limit[before]), cap), 0)
        got = np.minimum(np.maximum(h[live] - 1, 0), most)
        grow = np.flatnonzero(got < most)
        while len(grow):
            grow = grow[symbols[i[grow] + got[grow]] == symbols[before[grow] + got[grow]]]
            got[grow] += 1
            grow = grow[got[grow] < most[grow]]
        out[r] = got
        h[live] = got
        offset += 1
        live = live[starts[live] + offset < ends[live]]
    return out


def shard_repeats(pieces: list[bytes], kd: np.ndarray, kh: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window, is repeat) of every window in one shard; the first of equal windows by document and place is none."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16)
    symbols[ends] = -1  # between pieces
    order = suffix_array(symbols + 1)
    prefix = common_prefixes(symbols, order, starts, ends + 1, LENGTH + 1)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = np.repeat(ends, sizes + 1) - np.arange(len(symbols))
    # the suffix before in order may be no window, but then it shares fewer than LENGTH bytes
    windows = left[order] >= LENGTH
    group = np.cumsum(prefix < LENGTH)[windows]
    at = order[windows]
    own = piece[at]
    window = s0[own] + at - starts[own]
    by = np.lexsort((window, kh[own], kd[own], group))
    again = np.r_[False, group[by][1:] == group[by][:-1]]
    return own[by], window[by], again


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shard, shards, kd, kh, at, bytes) -> repeats; of keys in several shards also the windows left, to be merged."""
    for table in _whole_keys(batches, 2, lambda b: b.nbytes, SHARD_BYTES):
        pieces = table.column(6).to_pylist()
        many = table.column(2).to_numpy() > 1
        kd, kh, at = (table.column(c).to_numpy() for c in (3, 4, 5))
        s0 = at >> 32
        own, window, again = shard_repeats(pieces, kd, kh, s0)
        rkd, rkh, r0, r1 = _joined(kd[own[again]], kh[own[again]], window[again], window[again])
        none = pa.nulls(len(rkd), pa.binary())
        yield pa.record_batch([*map(pa.array, (rkd, rkh, _packed(r0, r1))), none], names=["kd", "kh", "at", "window"])
        left = np.flatnonzero(~again & many[own])
        if len(left):
            own, window = own[left], window[left]
            inside = window - s0[own]
            texts = pa.array([pieces[p][i:i + LENGTH] for p, i in zip(own, inside)], pa.binary())
            yield pa.record_batch([*map(pa.array, (kd[own], kh[own], _packed(window, window))), texts], names=["kd", "kh", "at", "window"])


def merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, window, kd, kh, at) sorted -> all but the first place of each window."""
    for table in _whole_keys(batches, 1, lambda b: b.num_rows, FOLD_RUNS):
        texts = np.array(table.column(1).to_pylist(), dtype=f"S{LENGTH}") if table.num_rows else np.zeros(0, f"S{LENGTH}")
        kd, kh, at = (table.column(c).to_numpy() for c in (2, 3, 4))
        distinct, first = np.unique(texts, return_index=True)  # input order is by document and place inside a window
        again = first[np.searchsorted(distinct, texts)] != np.arange(len(texts))
        rkd, rkh, r0, r1 = _joined(kd[again], kh[again], at[again] >> 32, at[again] & 0xFFFFFFFF)
        yield pa.record_batch([*map(pa.array, (rkd, rkh, _packed(r0, r1)))], names=["kd", "kh", "at"])


def fetch_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kd, kh, text, open runs) -> one row per open run with its bytes."""
    names = ["key", "kd", "kh", "at", "bytes"]
    for batch in batches:
        rows: list[tuple] = []
        for kd, kh, text, runs in zip(*(batch.column(c) for c in range(4))):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for run in runs.as_py():
                at = run["at"]
                rows.append((run["key"], kd.as_py(), kh.as_py(), at, raw[at >> 32:(at & 0xFFFFFFFF) + LENGTH]))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=names)


def cut_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kd, kh, text, window ranges) -> (kd, kh, n_bytes, removed spans, kept bytes)."""
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, ranges in zip(batch.column(2), batch.column(3)):
            raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
            at = np.array(ranges.as_py() or [], np.int64)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, at >> 32, 1)
            np.add.at(edge, (at & 0xFFFFFFFF) + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
            sizes.append(len(raw))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
            kept.append(raw[~gone].tobytes())
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
        ], names=["kd", "kh", "n_bytes", "removed", "kept"])


def without_repeats(docs: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): spans of removed bytes and the bytes left, per document row.

    Documents are ordered by id, null first; texts under one id are ordered by hash, and rows equal in both count as one
    document and each get its result. Null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing. A
    string that overlaps its earlier self counts. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kd = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    ids = docs.select(kd.alias("kd"))
    unique = ids.groupBy("kd").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    kh = F.lit(0).cast("long") if unique else F.xxhash64(whole())
    texts = docs.select(kd.alias("kd"), kh.alias("kh"), whole().alias("text"))

    runs = texts.mapInArrow(find_runs, _RUN_DDL).repartition("key").sortWithinPartitions("key", "content", "kd", "kh", "at")
    settled = scratch_path(spark, "runs")
    runs.mapInArrow(settle_runs, _RUN_DDL).write.parquet(settled)
    runs = spark.read.parquet(settled)
    open_runs = runs.filter("not repeat")

    crowded = open_runs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > shard_runs)
    crowded = crowded.select("key", F.ceil(F.col("n") / shard_runs).cast("int").alias("shards"))
    wanted = open_runs.groupBy("kd", "kh").agg(F.collect_list(F.struct("key", "at")).alias("runs"))  # bounded by the text
    fetched = texts.join(wanted, ["kd", "kh"]).select("kd", "kh", "text", "runs").mapInArrow(
        fetch_runs, "key bigint, kd bigint, kh bigint, at bigint, bytes binary")
    dealt = fetched.join(crowded, "key", "left").select(
        "key", F.pmod(F.xxhash64("kd", "kh", "at"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard"),
        F.coalesce("shards", F.lit(1)).alias("shards"), "kd", "kh", "at", "bytes")
    sorted_path = scratch_path(spark, "shards")
    dealt.repartition("key", "shard").sortWithinPartitions("key", "shard").mapInArrow(
        sort_shards, "kd bigint, kh bigint, at bigint, window binary").write.parquet(sorted_path)
    shards = spark.read.parquet(sorted_path)
    across = shards.filter("window is not null").select(F.xxhash64("window").alias("hash"), "window", "kd", "kh", "at")
    merged = across.repartition("hash").sortWithinPartitions("hash", "window", "kd", "kh", "at").mapInArrow(
        merge_shards, "kd bigint, kh bigint, at bigint")

    repeats = runs.filter("repeat").select("kd", "kh", "at").unionByName(
        shards.filter("window is null").select("kd", "kh", "at")).unionByName(merged)
    ranges = repeats.groupBy("kd", "kh").agg(F.collect_list("at").alias("ranges"))  # bounded by the text
    out = texts.join(ranges, ["kd", "kh"], "left").select("kd", "kh", "text", "ranges").mapInArrow(
        cut_repeats, "kd bigint, kh bigint, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept binary")
    return out.select(F.when(F.col("kd") != NO_ID, F.col("kd")).alias("doc_id"), "n_bytes", "removed", "kept")


def op4_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
