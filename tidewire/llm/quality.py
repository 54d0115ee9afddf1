"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

The score is the logistic of  b + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),  so all pairwise
interactions cost one pass over the features of a text. Features come from the text alone: never from labels, lang,
source or doc_id. The machine is fitted on at most ``SAMPLE_ROWS`` labelled documents (lowest hashes of the id), whose
sparse features alone reach the driver; every document is scored, whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import whole

SAMPLE_ROWS = 12_000
WORD_BINS = 1 << 15
FACTORS = 8
EPOCHS = 8
BATCH = 64
RATE = 0.08
DECAY = 2e-5
THRESHOLD = 0.3
FOLDS = 5
WORD_WEIGHT = 1.0
STRUCTURE_WEIGHT = 0.5

_CLASSES = np.zeros((9, 256))
for _row, _bytes in enumerate((
    range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", range(128, 192),
)):
    _CLASSES[_row, list(_bytes)] = 1
STRUCTURES = 9 + 10


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by 5 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def structure(text: str, counts: Counter) -> np.ndarray:
    """Shares of byte classes, then sizes and repetition of words and lines; all finite, also for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    total = max(1, len(raw))
    shares = _CLASSES @ np.bincount(raw, minlength=256) / total
    words = sum(counts.values())
    lines = text.split("\n")
    filled = [line for line in lines if line.strip()]
    ended = sum(line.rstrip()[-1] in ".!?\"')" for line in filled)
    per_word, per_line = max(1, words), max(1, len(filled))
    more = (
        np.log1p(len(text)), np.log1p(words), np.log1p(len(filled)), len(text) / per_word, len(counts) / per_word,
        len(set(filled)) / per_line, ended / per_line, np.log1p(words / per_line), max(counts.values(), default=0) / per_word,
        sum(n for w, n in counts.items() if len(w) <= 3) / per_word,
    )
    return np.r_[shares, more]


def features(text: str, bins: int = WORD_BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bins, their values with unit length, structure statistics)."""
    counts = Counter(text.lower().split())
    stats = structure(text, counts)
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), stats
    index = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % bins
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    index, place = np.unique(index, return_inverse=True)
    value = np.bincount(place, value)
    return index.astype(np.int32), (value / np.linalg.norm(value)).astype(np.float32), stats


@dataclass
class Machine:
    """Fitted weights; ``centre`` and ``spread`` standardise the structure statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    bins: int

    def row(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = np.clip((stats - self.centre) / self.spread, -4, 4) * STRUCTURE_WEIGHT
        return np.r_[index, self.bins + np.arange(len(stats))], np.r_[value * WORD_WEIGHT, scaled]

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index]
        first = value @ v
        return float(self.bias + value @ self.linear[index] + 0.5 * (first @ first - (value**2) @ (v**2).sum(axis=1)))

    def score(self, text: str) -> float:
        margin = self.margin(*self.row(*features(text, self.bins)))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, bins: int = WORD_BINS, factors: int = FACTORS,
        epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Minibatch AdaGrad on the logistic loss. Without rows, or with one class, the score is the smoothed share of label 1."""
    size = bins + STRUCTURES
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, STRUCTURES))
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, factors)), stats.mean(axis=0), stats.std(axis=0) + 1e-6, bins)
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    sparse = [m.row(*r) for r in rows]
    past_w, past_v, past_b = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            lengths = np.array([len(sparse[r][0]) for r in part])
            index, value = np.concatenate([sparse[r][0] for r in part]), np.concatenate([sparse[r][1] for r in part])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            v = m.factors[index]
            weighted = v * value[:, None]
            sums = np.add.reduceat(weighted, starts, axis=0)
            own = np.add.reduceat((weighted**2).sum(axis=1), starts)
            margin = m.bias + np.add.reduceat(m.linear[index] * value, starts) + 0.5 * ((sums**2).sum(axis=1) - own)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            pull = np.repeat(slope, lengths) * value
            seen, place = np.unique(index, return_inverse=True)
            grad_w = np.bincount(place, pull) + DECAY * m.linear[seen]
            each = pull[:, None] * (np.repeat(sums, lengths, axis=0) - weighted)
            grad_v = np.stack([np.bincount(place, each[:, f]) for f in range(factors)], axis=1) + DECAY * m.factors[seen]
            past_w[seen] += grad_w**2
            past_v[seen] += grad_v**2
            past_b += slope.sum() ** 2
            m.linear[seen] -= RATE * grad_w / np.sqrt(past_w[seen])
            m.factors[seen] -= RATE * grad_v / np.sqrt(past_v[seen])
            m.bias -= RATE * slope.sum() / np.sqrt(past_b)
    return m


def sample_features(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bins: int = WORD_BINS) -> DataFrame:
    """(doc_id, quality, index, value, stats) of at most ``sample_rows`` labelled documents outside the held-out fold.

    A label that is neither 0 nor 1 is ignored; a document labelled twice has its lower label.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the documented bound of the fit
    texts = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got = [features(t.as_py(), bins) for t in some.column(1)]
                yield pa.record_batch([
                    some.column(0), some.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                    pa.array([g[1] for g in got], pa.list_(pa.float32())), pa.array([g[2] for g in got], pa.list_(pa.float64())),
                ], names=["doc_id", "quality", "index", "value", "stats"])

    return texts.select("doc_id", "text", "quality").mapInArrow(
        extract, "doc_id bigint, quality int, index array<int>, value array<float>, stats array<double>")


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on the driver; repeated documents count once."""
    table = sample_features(docs, labels, sample_rows).toArrow().sort_by("doc_id")
    rows, marks, last = [], [], None
    for batch in table.to_batches():
        for at in range(batch.num_rows):
            doc_id = batch.column(0)[at].as_py()
            if doc_id != last:
                rows.append(tuple(batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4)))
                marks.append(batch.column(1)[at].as_py())
            last = doc_id
    return fit(rows, np.array(marks, float))


def scored(docs: DataFrame, machine: Machine, columns: list[str]) -> DataFrame:
    """``columns`` of every document and its score. Null texts are empty; an empty text has the score of its statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # size fixed by WORD_BINS and FACTORS
    source = docs.select(*columns, whole().alias("score_text"))
    schema = source.drop("score_text").schema.add("score", "double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = pa.array([m.score(t.as_py()) for t in batch.column(len(columns))], pa.float64())
            yield pa.record_batch([*batch.columns[:-1], found], names=[*columns, "score"])

    return source.mapInArrow(of, schema)


def op10_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, fitted(docs, labels), ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
