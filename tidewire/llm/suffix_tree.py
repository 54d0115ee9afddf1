"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of at most ``MAX_DEPTH`` words. Its distribution of the next word is smoothed with that of the
context one word shorter, down to single words with one added to each count:

    p(x | s) = (c(s x) + STRENGTH * p(x | s without its first word)) / (c(s) + STRENGTH)

A context seen often enough (the fourth root of the number of training tokens) is a state if it passes the divergence test: over its occurrences in the
training texts, the mean of ln p(x | s) / p(x | shorter) is at least ``DIVERGENCE``, each occurrence being left out of
the counts it is judged by. A word is scored in the state of the longest context before it. The contexts on the way
from a state to the root are its inner nodes: they smooth, whether or not they are states themselves.

How it runs. Texts are coded once into blocks of at most 2**20 tokens. Counts are found level by level: each block asks
for the total of each *different* n-gram it holds, so a frequent one weighs no more than a rare one. Requests are
dealt by hash ranges, added up there, and the totals go back to the blocks that asked. Only n-grams whose context has
enough occurrences are asked for, and none whose shorter form one block alone holds, as its total is known there.
The tests of the contexts travel the same way. The model is thus spread over the blocks and grows with the corpus; no
node, word or table is gathered in one place.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import drop_shuffles, whole
from tidewire.session import cut_lineage

MAX_DEPTH = 2
EVIDENCE = 0.25  # a context needs as many occurrences as this power of the number of training tokens
STRENGTH = 200.0
DIVERGENCE = 0.02
FOLDS, HELD_OUT = 7, 2

BITS = 21  # of a place in a block, of a word and of an n-gram of a block: three of them make one sortable key
BLOCK_TOKENS = 1 << 20  # at most 1 << BITS
SCALE = 1024.0  # log ratios are added up as whole numbers, so that sums do not depend on their order

BLOCK = ("block bigint, row array<bigint>, doc_id array<bigint>, held array<boolean>, lead array<int>, size array<int>, "
         "codes binary, words binary")


def least_count(n: int) -> int:
    """Occurrences a context needs among ``n`` training tokens: the number of contexts that have them grows with the corpus."""
    return max(2, math.ceil(n**EVIDENCE))


def _packed(values: np.ndarray) -> bytes:
    """Squeezed 64-bit numbers, all lowest bytes first, so that unused high bytes compress to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64, copy=False)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _squeezed(codes: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _spread(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=3 * n, codec="zstd"), np.uint8).reshape(3, n)
    out = np.zeros((n, 4), np.uint8)
    out[:, :3] = raw.T
    return out.view("<i4").ravel()


def blocks(docs: DataFrame, depth: int = MAX_DEPTH, limit: int = BLOCK_TOKENS) -> DataFrame:
    """Coded texts: words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end (an empty word).

    A text longer than a block goes on in the next one, which repeats ``lead`` tokens of it as context. ``row`` numbers
    the documents: repeated rows and null ids keep apart.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = TaskContext.get().partitionId() << 32
        made, row, filled = 0, 0, 0
        codes: defaultdict[bytes, int] = defaultdict()
        parts: list[tuple] = []
        held: list[np.ndarray] = []

        def start() -> None:
            nonlocal filled
            codes.clear()
            codes.default_factory = codes.__len__
            parts.clear()
            held.clear()
            filled = 0

        def ready() -> pa.RecordBatch:
            nonlocal made
            words = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))
            tokens = np.concatenate(held)
            often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")  # small codes for frequent words
            code = np.empty(len(often), np.int32)
            code[often] = np.arange(len(often), dtype=np.int32)
            columns = list(zip(*parts))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
            out = pa.record_batch([pa.array([home + made], pa.int64()), *(pa.array([list(c)], pa.list_(k)) for c, k in zip(columns, kinds)),
                                   pa.array([_squeezed(code[tokens])], pa.binary()), pa.array([words[often].tobytes()], pa.binary())],
                                  names=["block", "row", "doc_id", "held", "lead", "size", "codes", "words"])
            made += 1
            return out

        start()
        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_py().encode("utf-8", "surrogatepass").lower().split()
                words.append(b"")
                at = 0
                while at < len(words):
                    lead = min(at, depth)
                    if filled and filled + lead + len(words) - at > limit:
                        yield ready()
                        start()
                    end = min(len(words), at - lead + limit)
                    held.append(np.fromiter(map(codes.__getitem__, words[at - lead:end]), np.int32, end - at + lead))
                    parts.append((home + row, doc_id, out, lead, end - at + lead))
                    filled += end - at + lead
                    at = end
                row += 1
        if parts:
            yield ready()

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), whole().alias("text"))
    spark = docs.sparkSession
    splits = 2 * max(source.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    with adaptive_off(spark):  # else the checkpoint forgets how it is partitioned, and each join would shuffle it again
        coded = cut_lineage(source.mapInArrow(of, BLOCK).repartition(splits, "block"))
    drop_shuffles(spark)
    return coded


@contextmanager
def adaptive_off(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Level:
    """n-grams of one length in a block. ``ids`` names the one that ends at each place, -1 where none is looked at."""

    ids: np.ndarray
    hashes: np.ndarray
    own: np.ndarray  # occurrences in this block's training texts
    before: np.ndarray | None = None  # the context of each n-gram, in the level below
    total: np.ndarray | None = None  # in all training texts
    shared: np.ndarray | None = None  # whether another block holds it too
    asked: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # n-grams asked for, by hash


class Block:
    """One block with as many levels as have been answered."""

    def __init__(self, row: dict, answers: list[np.ndarray], n: int):
        self.row, self.least = row, least_count(n)
        size, lead = np.array(row["size"], np.int64), np.array(row["lead"], np.int64)
        self.starts = np.cumsum(size) - size
        self.codes = _spread(row["codes"], int(size.sum()))
        self.age = np.arange(len(self.codes), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), size)
        self.counted = self.age >= np.repeat(lead, size)
        self.train = self.counted & ~np.repeat(np.array(row["held"], bool), size)
        self.levels = [self._first()]
        for answer in answers:
            self.told(answer)
            self.levels.append(self._next(self.levels[-1]))

    def told(self, answer: np.ndarray) -> None:
        """Take the totals of what the last level asked for."""
        level = self.levels[-1]
        level.total, level.shared = level.own.copy(), np.zeros(len(level.own), bool)
        level.total[level.asked], level.shared[level.asked] = _answer(answer)

    def _level(self, ids: np.ndarray, hashes: np.ndarray, asked: np.ndarray, before: np.ndarray | None = None) -> Level:
        here = ids[self.train]
        own = np.bincount(here[here >= 0], minlength=len(hashes))
        return Level(ids, hashes, own, before, asked=asked[np.argsort(hashes[asked])])

    def _first(self) -> Level:
        words = np.frombuffer(self.row["words"], np.uint64)
        return self._level(self.codes, words, np.arange(len(words)))

    def _next(self, level: Level) -> Level:
        before = np.append(np.int32(-1), level.ids[:-1])
        length = len(self.levels)
        open_ = np.flatnonzero((self.age >= length) & (before >= 0) & (np.append(level.total, 0)[before] >= self.least))
        key = (before[open_].astype(np.uint64) << np.uint64(2 * BITS)) | (self.codes[open_].astype(np.uint64) << np.uint64(BITS)) | open_.astype(np.uint64)
        key.sort()
        place = (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
        gram = key >> np.uint64(BITS)
        new = np.r_[True, gram[1:] != gram[:-1]][:len(gram)]
        ids = np.full(len(self.codes), -1, np.int32)
        ids[place] = np.cumsum(new) - 1
        first = place[new]
        hashes = _mixed(level.hashes[before[first]] * np.uint64(0x9E3779B97F4A7C15) + _mixed(self.levels[0].hashes[self.codes[first]] + np.uint64(length)))
        return self._level(ids, hashes, np.flatnonzero(level.shared[level.ids[first]]), before[first])

    def request(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, ascending, of the n-grams of the last level whose totals are not known here, and their counts here."""
        level = self.levels[-1]
        return level.hashes[level.asked], level.own[level.asked]

    def ladder(self, n: int, v: int, leave_out: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, contexts, probabilities) by length of the context; places of each are among those of the one before.

        With ``leave_out`` only training tokens are looked at, each taken out of all counts.
        """
        less = 1.0 if leave_out else 0.0
        place = np.flatnonzero(self.train if leave_out else self.counted).astype(np.int32)
        p = (self.levels[0].total[self.codes[place]] + (1 - less)) / (n - less + v + 1)
        out = [(place, np.zeros(0, np.int32), p)]
        for below, level in zip(self.levels, self.levels[1:]):
            inside = level.ids[place] >= 0
            place, gram = place[inside], level.ids[place[inside]]
            context = level.before[gram]
            p = (level.total[gram] - less + STRENGTH * p[inside]) / (below.total[context] - less + STRENGTH)
            out.append((place, context, p))
        return out

    def contexts(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(contexts of each length that are followed here, their hashes in one array, the order by hash)."""
        held = [np.unique(level.before) for level in self.levels[1:]]
        keys = [_mixed(level.hashes[h] + np.uint64(n)) for n, (level, h) in enumerate(zip(self.levels, held), 1)]
        every = np.concatenate(keys or [np.zeros(0, np.uint64)])
        return held, every, np.argsort(every)

    def tests(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ascending, of the contexts in this block, their summed log ratios)."""
        steps = self.ladder(n, v, True)
        held, every, order = self.contexts()
        sums = [np.zeros(0, np.int64)]
        for length, names in enumerate(held, 1):
            (above, _, q), (places, context, p) = steps[length - 1:length + 1]
            ratio = np.log(p / q[np.searchsorted(above, places)])
            sums.append(np.rint(np.bincount(context, ratio, len(self.levels[length - 1].hashes)) * SCALE).astype(np.int64)[names])
        return every[order], np.concatenate(sums)[order]

    def scores(self, n: int, v: int, answer: np.ndarray) -> dict[str, np.ndarray]:
        """Sums per piece of a document."""
        steps = self.ladder(n, v, False)
        names, _, order = self.contexts()
        gains = np.zeros(len(order))
        gains[order] = _answer(answer)[0]
        best, depth = np.zeros(len(self.codes)), np.zeros(len(self.codes), np.int64)
        best[steps[0][0]] = np.log10(steps[0][2])
        base, at = best.copy(), 0
        for length, held in enumerate(names, 1):
            kept = np.zeros(len(self.levels[length - 1].hashes), bool)
            kept[held] = gains[at:at + len(held)] >= DIVERGENCE * SCALE * self.levels[length - 1].total[held]
            at += len(held)
            places, context, p = steps[length]
            in_state = kept[context]
            best[places[in_state]] = np.log10(p[in_state])
            depth[places[in_state]] = length
        known = self.counted & (self.levels[0].total[self.codes] > 0)

        def added(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, self.starts)

        return {"n_tokens": added(self.counted.astype(np.int64)), "n_known": added(known.astype(np.int64)),
                "n_in_states": added((depth > 0).astype(np.int64)), "base_score": added(base), "score": added(best)}


def _answer(told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and whether more than one block asked."""
    return told >> 1, (told & 1).astype(bool)


def _rows(columns: list[str], answers: int) -> Callable[[pa.RecordBatch], Iterator[tuple[dict, list[np.ndarray]]]]:
    def of(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[np.ndarray]]]:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in columns}
            got = [[_unpacked(p["totals"]) for p in batch.column(f"answer{k}")[i].as_py() or []] for k in range(answers)]
            yield row, [np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64) for parts in got]
    return of


def answered(frame: DataFrame, ask: Callable[[dict, list[np.ndarray]], tuple[np.ndarray, np.ndarray]], done: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Totals over all blocks of what each block asks for: (one row per block and hash range, the frame with them joined).

    ``ask`` gives ascending hashes and a number for each. Requests are cut by hash ranges, one per block on average, so
    a range holds about as many hashes as a block asks for.
    """
    columns = [c for c in frame.columns if not c.startswith("answer")]
    rows = _rows(columns, done)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, got in rows(batch):
                keys, values = ask(row, got)
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    some = slice(cuts[b], cuts[b + 1])
                    steps = np.diff(keys[some], prepend=np.uint64(0))
                    yield pa.record_batch([pa.array([int(b)], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([_packed(steps)], pa.binary()),
                                           pa.array([_packed(values[some].view(np.uint64))], pa.binary())], names=["bucket", "block", "keys", "numbers"])

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
        numbers = np.concatenate([_unpacked(v.as_py()).view(np.int64) for v in table.column("numbers")])
        place, different = pd.factorize(np.concatenate(keys))
        sums = np.bincount(place, numbers, len(different)).astype(np.int64)
        several = np.bincount(place, minlength=len(different)) > 1
        back, at = [], 0
        for k in keys:
            back.append(_packed((2 * sums + several)[place[at:at + len(k)]].view(np.uint64)))
            at += len(k)
        n = len(keys)
        return pa.table([table.column("block"), table.column("bucket"), pa.array(back, pa.binary()),
                         pa.array([int((sums > 0).sum())] * n, pa.int64()), pa.array([int(sums.sum())] * n, pa.int64())],
                        names=["block", "bucket", "totals", "seen", "mass"])

    asked = frame.mapInArrow(requests, "bucket int, block bigint, keys binary, numbers binary")
    told = cut_lineage(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        add, "block bigint, bucket int, totals binary, seen bigint, mass bigint"))
    del asked
    drop_shuffles(frame.sparkSession)
    mine = told.repartition(frame.rdd.getNumPartitions(), "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals"))).alias(f"answer{done}"))
    return told, frame.join(mine.hint("merge"), "block", "left")  # the answers are as large as the corpus


def scored(docs: DataFrame, depth: int = MAX_DEPTH, limit: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_in_states) of every document row.

    Null and empty texts are one end token. A null id counts as '' for the fold. Repeated rows are learned and scored
    each on their own. Extra columns are ignored; an empty table gives no rows.
    """
    coded = blocks(docs, depth, limit)
    number = max(1, coded.count())
    columns = coded.columns
    frame, n, v = coded, 0, 0
    for level in range(depth + 1):
        told, frame = answered(frame, lambda row, got: Block(row, got, n).request(), level, number)
        if level == 0:
            mass = told.select("bucket", "seen", "mass").distinct().agg(F.sum("seen"), F.sum("mass")).first()
            v, n = mass[0] or 0, mass[1] or 0
    _, frame = answered(frame, lambda row, got: _finished(row, got, n).tests(n, v), depth + 1, number)
    rows = _rows(columns, depth + 2)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, got in rows(batch):
                sums = _finished(row, got[:-1], n).scores(n, v, got[-1])
                yield pa.record_batch([pa.array(row["row"], pa.int64()), pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()),
                                       *map(pa.array, sums.values())], names=["row", "doc_id", "held_out", *sums])

    pieces = frame.mapInArrow(of, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_in_states bigint, "
                                  "base_score double, score double")
    return pieces.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in pieces.columns[3:])).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score", "n_in_states")


def _finished(row: dict, answers: list[np.ndarray], n: int) -> Block:
    """A block whose every level has its totals."""
    block = Block(row, answers[:-1], n)
    block.told(answers[-1])
    return block


def op13_lm_scoring(docs: DataFrame) -> DataFrame:
    return scored(docs)
