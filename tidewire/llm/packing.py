"""Packing by powers of two: each document is cut into pieces of binary length, and pieces of one length form a bucket.

A piece is a training sequence of its own, so no sequence crosses documents and none needs padding; a batch is drawn
from one bucket. A document of n tokens gives n // limit pieces of the full length and one piece for each binary digit
of the rest, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import tokens
from tidewire.llm.common import numbered, whole

LIMIT = 1024
END = 0
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order; ``limit`` is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, limit: int = LIMIT, path: str = tokens.TOKENIZER_FILE, ranks: str | None = tokens.RANK_FILE,
           end: int = END) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens.

    ``end`` closes each document. A null or empty text is the single token ``end``. Repeated rows are cut each on its
    own. A null doc_id stays null. Extra columns are ignored; an empty table gives no pieces.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, ranks)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end], "<u4")
                at = 0
                for length in binary_lengths(len(ids), limit):
                    rows.append((doc_id, at, length, ids[at:at + length].tobytes(), len(ids)))
                    at += length
                held += len(ids)
                if held > 500_000:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return docs.select("doc_id", whole().alias("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def in_buckets(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Place each piece: ``bucket`` is its length, ``bucket_row`` its gapless place there, ``sequence_id`` unique over all."""
    buckets = limit.bit_length()
    return numbered(cut, ["length"], ["doc_id", "start"], "bucket_row").withColumns({
        "bucket": F.col("length"), "offset": F.lit(0).cast("long"),
        "sequence_id": F.col("bucket_row") * buckets + F.round(F.log2("length")).cast("long")})


def pack(docs: DataFrame, limit: int = LIMIT, path: str = tokens.TOKENIZER_FILE, ranks: str | None = tokens.RANK_FILE) -> DataFrame:
    """Whole pieces with their token ids, placed in buckets."""
    return in_buckets(pieces(docs, limit, path, ranks), limit)


def op3_packing(docs: DataFrame) -> DataFrame:
    cut = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return in_buckets(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "bucket_row")
