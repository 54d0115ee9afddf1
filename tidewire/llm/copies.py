"""Near copies: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, in components.

Links come from two sides and each is checked on the whole sets. The Gray index of ``simhash`` links fingerprints that
differ in few bits; at Jaccard 0.8 two of them differ in about ten, so it cannot reach all. Shared signatures do: put
in one order, two such sets share a shingle among their first n - ceil(0.8 n) + 1. The order starts with shingles of
thinly filled hash buckets, so common passages make few signatures. A tenth of each set is dealt out in excess of that:
two linked sets share as many signatures as the smaller one has in excess, so sets that share fewer with all are out.

Sets of one signature never all meet. Every set first meets ``HEADS`` heads of its signature. What is then in one component
needs no more checks: where at most ``CALM`` sets lie outside the largest component of a signature, these meet all
others, which is exact and linear. A signature with more of them takes new heads; if that goes on, it is replaced by
signatures of one more shared shingle each (two sets share k shingles among their first n - ceil(0.8 n) + k), so its
groups shrink. Before sets are compared, the parities of their shingles over 256 buckets bound how many differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import drop_shuffles, whole
from tidewire.llm.simhash import RADIUS, SEED, first_rows, near_edges
from tidewire.operators.graph import connected_components
from tidewire.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BUCKETS = 1 << 16
EPS = 1e-9
CALM = 1000
HEADS = 8  # heads a crowded signature tries at once
TURNS = 2  # times it does so before it is replaced by longer ones
SHARED = 4  # shingles a signature has at most; sets of five shingles or more that are alike share as many
PARITY = ("p0", "p1", "p2", "p3")


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words is one shingle, without words it has none."""
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits, one per bucket of hashes: whether it holds an odd number of them. Two sets differ at least where these do."""
    odd = np.bincount((hashes >> np.uint64(32) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def rare_first(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes by how full their bucket is, then by value."""
    return hashes[np.lexsort((hashes, counts[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]))]


def bucket_counts(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Occurrences of shingles by hash bucket: a table of fixed size."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount((shingles(text.as_py(), size) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        full = np.flatnonzero(n)
        yield pa.record_batch([pa.array(full), pa.array(n[full])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in docs.select(whole().alias("text")).mapInArrow(of, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def named_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, kh, key, fp, parities) of every row: ``key`` names the set of shingles, ``fp`` is its SimHash."""
    names = ["doc_id", "kh", "key", "fp", *PARITY]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(2)]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            codes = np.array([simhash(s) for s in sets], np.uint64)
            odd = np.array([parities(s) for s in sets], np.int64).reshape(-1, 4)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), pa.array(codes.view(np.int64)),
                                   *(pa.array(odd[:, i]) for i in range(4))], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole()).alias("kh"), whole().alias("text"))
    return source.mapInArrow(of, ", ".join(f"{n} bigint" for n in names))


def shared_signatures(docs: DataFrame, counts: np.ndarray, t: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(sig, key, size, pos) of signatures that several sets hold, for the sets that can have a link."""
    told = docs.sparkSession.sparkContext.broadcast(counts)  # a table of fixed size

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), size)
                if not len(s):
                    continue
                own = len(s) - math.ceil(t * len(s) - EPS)
                head = min(len(s), own + max(1, len(s) // 10))
                first = rare_first(s, told.value)[:head]
                key = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(first.view(np.int64)), pa.array(np.repeat(key, head)),
                                       pa.array(np.full(head, len(s), np.int32)), pa.array(np.arange(head, dtype=np.int32))],
                                      names=["sig", "key", "size", "pos"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (sig, key); one row waits for the next batch, however many sets hold its signature."""
        names, held, before = ["sig", "key", "size", "pos"], np.zeros((4, 0), np.int64), False
        for batch in batches:
            got = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if not got.shape[1]:
                continue
            got = got[:, np.r_[True, (got[:2, 1:] != got[:2, :-1]).any(axis=0)]]  # a set counts once
            same = got[0, 1:] == got[0, :-1]
            many = np.r_[before, same] | np.r_[same, False]
            yield pa.record_batch([pa.array(c) for c in got[:, :-1][:, many[:-1]]], names=names)
            held, before = got[:, -1:], bool(np.r_[before, same][-1])
        if before:
            yield pa.record_batch([pa.array(c) for c in held], names=names)

    longs = "sig bigint, key bigint, size bigint, pos bigint"
    dealt = docs.select(whole().alias("text")).mapInArrow(deal, "sig bigint, key bigint, size int, pos int")
    rows = dealt.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(several, longs)
    own = F.col("size") - F.ceil(F.col("size") * t - EPS)
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * t - EPS) / 10))  # what the smallest partner deals out in excess
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return rows.filter((F.col("n") >= least) & (F.col("pos") <= own)).drop("n")


def longer_signatures(signs: DataFrame, sets: DataFrame, counts: np.ndarray, shared: int, t: float) -> DataFrame:
    """``signs`` with each signature replaced by those of one more shingle, ``shared`` in all, that comes later in the set's order."""
    told = signs.sparkSession.sparkContext.broadcast(counts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig, at, tokens in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                s = rare_first(tokens.values.to_numpy().view(np.uint64), told.value)
                start, stop = at["pos"].as_py() + 1, min(len(s), len(s) - math.ceil(t * len(s) - EPS) + shared)
                more = s[start:stop] * np.uint64(0x9E3779B97F4A7C15) ^ np.array([sig], np.int64).view(np.uint64)
                more = (more ^ more >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.record_batch([pa.array(more.view(np.int64)), pa.array([at.as_py()] * len(more), at.type), pa.array(np.arange(start, start + len(more)))],
                                      names=["sig", "at", "later"])

    held = signs.select("sig", "at", F.col("at.key").alias("key")).join(sets, "key").select("sig", "at", "tokens")
    kind = signs.schema["at"].dataType.simpleString()
    longer = held.mapInArrow(of, f"sig bigint, at {kind}, later bigint")
    return longer.select("sig", F.col("at").withField("pos", F.col("later")).alias("at"))


def whole_sets(docs: DataFrame, marked: DataFrame, keys: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(key, tokens) of the sets named in ``keys``, each from one document that holds it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "tokens"])

    one = marked.join(keys, "key", "left_semi").groupBy("key").agg(F.min_by("kh", "kh").alias("kh"))
    texts = docs.select(F.xxhash64(whole()).alias("kh"), whole().alias("text"))
    held = texts.join(one, "kh").select("key", "text").mapInArrow(of, "key bigint, tokens array<bigint>")
    return held.dropDuplicates(["key"])


def alike(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach ``t``."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.filter(F.col("c") >= (F.col("n") - F.col("c")) * t - EPS).select("a", "b")


def _can_reach(x: str, y: str, t: float, shared: int) -> Column:
    """Bounds on sizes, on what can be shared from the places of a common signature on, and on what differs."""
    xs, ys = F.col(f"{x}.size"), F.col(f"{y}.size")
    rest = F.least(xs - F.col(f"{x}.pos"), ys - F.col(f"{y}.pos")) + (shared - 1)
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY), F.lit(0))
    return ((xs >= ys * t - EPS) & (ys >= xs * t - EPS) & (rest >= (xs + ys) * (t / (1 + t)) - EPS)
            & (apart <= (xs + ys) * ((1 - t) / (1 + t)) + EPS))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(docs: DataFrame, t: float = SIMILARITY, size: int = SHINGLE, calm: int = CALM) -> DataFrame:
    """(doc_id, kh, root) of every row: root is the same for rows that links of at least ``t`` connect.

    Null, empty and blank texts are alike. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = cut_lineage(named_sets(docs, size))
    counts = bucket_counts(docs, size)
    bits = marked.select("key", *PARITY).dropDuplicates(["key"])
    signs = cut_lineage(shared_signatures(docs, counts, t, size).join(bits, "key").select("sig", F.struct("key", "size", "pos", *PARITY).alias("at")))
    drop_shuffles(spark)
    tokens = cut_lineage(whole_sets(docs, marked, signs.select("at.key").distinct(), size))

    # neighbours in the Gray index
    coded = marked.join(tokens.select("key"), "key", "left_semi").select("key", "fp").distinct()
    codes = cut_lineage(coded.groupBy("fp").agg(F.min("key").alias("first")))
    near = near_edges(codes, RADIUS).distinct()
    near = near.join(codes.toDF("a", "ka"), "a").join(codes.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = coded.join(codes, "fp").filter(F.col("key") != F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b"))
    links = cut_lineage(alike(_ordered(near.unionByName(same)), tokens, t))
    parts, turn, shared = None, 0, 1
    while True:
        # signatures whose sets are not all in one component yet
        placed = signs.withColumn("part", F.col("at.key"))
        if parts is not None:
            placed = signs.join(parts, F.col("at.key") == F.col("key"), "left").select("sig", "at", F.coalesce("component", "at.key").alias("part"))
        placed = cut_lineage(placed)
        most = placed.groupBy("sig", "part").agg(F.count("*").alias("n")).groupBy("sig").agg(
            F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
        last = turn > TURNS * SHARED
        quiet = (F.col("n") - F.col("most.n") <= calm) | F.lit(last)
        open_ = cut_lineage(placed.join(most.select("sig", F.col("most.part").alias("most"), (quiet & F.lit(turn > 0)).alias("quiet")), "sig"))
        # quiet ones: what lies outside the largest component meets all others; crowded ones: all meet a head
        outside = open_.filter("quiet and part <> most").select("sig", F.col("at").alias("x"), F.col("part").alias("px"))
        every = open_.filter("quiet").select("sig", F.col("at").alias("y"), F.col("part").alias("py"))
        met = outside.join(every, "sig")
        crowded = open_.filter("not quiet")
        heads = crowded.groupBy("sig").agg(F.array_distinct(F.array(*(
            F.min_by(F.struct("at", "part"), F.xxhash64(F.lit(turn * HEADS + i), "at.key")) for i in range(HEADS)))).alias("h"))
        star = crowded.join(heads, "sig").select("sig", F.col("at").alias("x"), F.col("part").alias("px"), F.explode("h").alias("h")).select(
            "sig", "x", "px", F.col("h.at").alias("y"), F.col("h.part").alias("py"))
        tried = met.unionByName(star).filter((F.col("px") != F.col("py")) & _can_reach("x", "y", t, shared)).select(
            F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        found = cut_lineage(alike(_ordered(tried), tokens, t))
        drop_shuffles(spark)
        if not found.isEmpty():
            links = links.unionByName(found)
        if parts is None or not found.isEmpty():
            parts = cut_lineage(connected_components(links).select(F.col("id").alias("key"), "component"))
            drop_shuffles(spark)
        signs = crowded.select("sig", "at")
        if last or signs.isEmpty():
            break
        turn += 1
        if turn % TURNS == 0 and shared < SHARED:
            shared += 1
            signs = cut_lineage(longer_signatures(signs, tokens, counts, shared, t))
    return marked.select("doc_id", "kh", "key").join(parts, "key", "left").select(
        "doc_id", "kh", F.coalesce("component", "key").alias("root"))


def representatives(docs: DataFrame) -> DataFrame:
    """Whole rows of ``docs``, one per component of near copies: that of the smallest doc_id (then hash of the text; null ids last)."""
    return first_rows(docs, cut_lineage(near_components(docs)))
