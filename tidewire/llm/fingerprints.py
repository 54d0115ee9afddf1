"""Document fingerprints: mergeable bottom-k sketches of word-shingle hashes, as column expressions.

A sketch is the ascending array of the ``k`` lowest distinct 64-bit hashes of a text's word shingles. The lowest k of
two sketches together are the sketch of both texts, so sketches of parts merge without the texts. Words are
lower-cased and split at white space; a text with fewer words than a shingle has one shingle, its whole word list; a
text without words (empty, null or blank) has the empty sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import KEY, let, ordered_neighbours, text_key, whole

K = 128
SHINGLE = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hash of every run of ``size`` words, in order, repeats included."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(w[i + j] for j in range(size))))
        short = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
        return F.when(F.size(w) >= size, runs).otherwise(short)

    return let(words(text), of)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets: 1 for two empty sketches, 0 if just one is empty."""

    def of(low: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(low, a), b))
        return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(shared / F.size(low))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) over the k-th hash as a fraction."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that are also in ``b``: 1 if ``a`` is empty."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as 16 hex digits per hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged_sketches(df: DataFrame, keys: Sequence[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of rows: (keys..., sketch).

    Each task keeps the lowest hashes of a group before the shuffle, so a group that holds most rows costs no more
    than k values per task. Groups whose sketches are all empty get the empty sketch.
    """
    hashes = df.select(*keys, F.explode(column).alias("hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    low = hashes.withColumn("rank", rank).filter(F.col("rank") <= k)
    low = low.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("found"))
    same = F.lit(True)
    for key in keys:
        same &= F.col(f"g_{key}").eqNullSafe(F.col(key))
    groups = df.select(*(F.col(key).alias(f"g_{key}") for key in keys)).distinct()
    return groups.join(low, same, "left").select(
        *(F.col(f"g_{key}").alias(key) for key in keys),
        F.coalesce("found", F.array().cast("array<bigint>")).alias("sketch"))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key of each document with the key of the next one by ascending id (null ids first; after the last, the first)."""
    keys = docs.select(*text_key(id_col, text_col), F.char_length(whole(text_col)).alias("n_chars"))
    return ordered_neighbours(keys, ["n_chars"])


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Sketches of each text and of its edited form, with likeness to the edited form and to the next text.

    The edited text is the text with its last floor(n / 4) code points replaced by as many from the head of the next
    document in ascending id. Nulls are empty texts. Documents of one id are ordered by the hash of their text;
    repeated rows count as one document for "next", and each gets the same result. Columns other than doc_id and text
    are ignored. An empty table gives no rows.
    """
    texts = docs.select(*text_key(), whole().alias("text"))  # the same columns on both sides, so one shuffle serves both
    pairs = successors(docs)
    prev = pairs.select(*(F.col(c).alias(f"prev_{c}") for c in KEY), F.floor(F.col("n_chars") / 4).cast("int").alias("tail"),
                        *(F.col(f"next_{c}").alias(c) for c in KEY))
    heads = texts.join(prev, list(KEY)).select(
        *(F.col(f"prev_{c}").alias(c) for c in KEY), F.substring(F.col("text"), F.lit(1), F.col("tail")).alias("head"),
        sketch(F.col("text"), k, size).alias("next_sketch"))
    heads = heads.dropDuplicates(list(KEY))  # repeated rows send the same head
    n = F.char_length("text")
    kept = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 4).cast("int"))
    both = texts.join(heads, list(KEY)).select(
        F.when(F.col("kn"), F.col("kd")).alias("doc_id"), n.cast("long").alias("n_chars"), F.concat(kept, F.col("head")).alias("edited"),
        sketch(F.col("text"), k, size).alias("sketch"), "next_sketch")
    return both.withColumns({"edited_sketch": sketch(F.col("edited"), k, size)})


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    rows = edited_fingerprints(docs)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"))
