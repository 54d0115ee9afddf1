"""Benchmark decontamination as a prefix-filtered set join with exact verification, in DataFrame operations only.

A benchmark item is seen as its windows: every run of ``window`` consecutive words, or the whole item if it is
shorter. A document word is hit if it lies in an occurrence of a window. Containment must be complete, so the
necessary prefix of a window is a single shingle, its rarest: a document without it cannot hold the window.

1. One pass over the texts keeps each position whose shingle occurs in the benchmark, with the words around it.
2. Shingles are counted over all documents, and each window is entered under its rarest shingle.
3. Kept positions meet the windows of their shingle; bounds on length and position discard candidates that stick out.
4. The words of what is left are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import KEY, text_key, whole
from tidewire.session import cut_lineage

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and code points above 127, with A-Z in lower case."""
    folded = F.translate(text, _UPPER, _LOWER)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame that has at most ``rows`` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: (window_id, wanted, items). Items without words have none."""
    w = items.select("item_id", words(whole()).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    runs = w.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), F.lit(window)).alias("wanted"))
    return runs.groupBy("wanted").agg(F.collect_set("item_id").alias("items")).select(
        F.xxhash64("wanted").alias("window_id"), "wanted", "items")


def _hash(array: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*(array[at + j] for j in range(width)))


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(width, hash, offset, window_id): the shingles inside each window; a window shorter than a shingle is one."""
    out = None
    for width in range(1, shingle + 1):
        fits = windows.filter(F.least(F.size("wanted"), F.lit(shingle)) == width)
        part = fits.select("window_id", "wanted", F.explode(F.sequence(F.lit(0), F.size("wanted") - width)).alias("offset")).select(
            F.lit(width).alias("width"), _hash(F.col("wanted"), F.col("offset"), width).alias("hash"), "offset", "window_id")
        out = part if out is None else out.unionByName(part)
    return out


def occurrences(docs: DataFrame, shingles: DataFrame, widths: list[int], window: int = WINDOW) -> DataFrame:
    """One row per document (``hash`` null, with n_words) and one per position whose shingle is in the benchmark."""
    texts = docs.select("doc_id", *text_key(), words(whole()).alias("words"))
    known = _small(shingles.select("width", "hash").distinct())

    def hashes(width: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: _hash(F.col("words"), i, width))
        return F.when(F.size("words") >= width, runs).otherwise(F.array().cast("array<bigint>"))

    out = None
    for n, width in enumerate(widths or [1]):
        # the leading null stands for the document itself
        lead = F.array(F.lit(None).cast("bigint")) if n == 0 else F.array().cast("array<bigint>")
        arrays = texts.withColumn("hashes", F.concat(lead, hashes(width)))
        # outer: an inner generator would make the optimizer test the array's size on the text, word by word
        rows = arrays.select("doc_id", *KEY, "words", F.posexplode_outer("hashes").alias("at", "hash"))
        rows = rows.withColumn("at", F.col("at") - (1 if n == 0 else 0))
        here = known.filter(F.col("width") == width).select(F.col("hash").alias("known"))
        met = rows.join(_small(here), F.col("hash") == F.col("known"), "left")
        met = met.filter(F.col("known").isNotNull() | (F.col("hash").isNull() if n == 0 else F.lit(False)))
        first = F.greatest(F.col("at") - (window - 1), F.lit(0))
        part = met.select(
            "doc_id", *KEY, F.lit(width).alias("width"), "hash", "at", F.size("words").cast("long").alias("n_words"),
            F.when(F.col("hash").isNotNull(), first).alias("around_at"),
            F.when(F.col("hash").isNotNull(), F.slice("words", first + 1, F.lit(2 * window - 1))).alias("around"))
        out = part if out is None else out.unionByName(part)
    return out


def prefixes(shingles: DataFrame, found: DataFrame) -> DataFrame:
    """The rarest shingle of each window by its count over all documents: (width, hash, offset, window_id)."""
    counts = found.filter(F.col("hash").isNotNull()).groupBy("width", "hash").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, ["width", "hash"])  # a window with a shingle that no document holds occurs nowhere
    whole_windows = shingles.groupBy("window_id").agg(F.countDistinct("hash").alias("all"))
    present = ranked.groupBy("window_id").agg(F.countDistinct("hash").alias("there"), F.min(F.struct("n", "width", "hash", "offset")).alias("best"))
    return present.join(whole_windows, "window_id").filter(F.col("all") == F.col("there")).select(
        "best.width", "best.hash", "best.offset", "window_id")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents with n_words, verified occurrences): the latter are (kn, kd, kh, start, length, items)."""
    windows = cut_lineage(item_windows(items, window))
    shingles = cut_lineage(window_shingles(windows, shingle))
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # at most ``shingle`` values
    found = cut_lineage(occurrences(docs, shingles, widths, window))
    there = found.filter(F.col("hash").isNull()).select("doc_id", *KEY, "n_words")
    entered = prefixes(shingles, found).join(windows, "window_id")
    near = found.filter(F.col("hash").isNotNull()).join(_small(entered), ["width", "hash"])
    start = F.col("at") - F.col("offset")
    near = near.filter((start >= 0) & (start + F.size("wanted") <= F.col("n_words")))
    same = F.slice("around", start - F.col("around_at") + 1, F.size("wanted")) == F.col("wanted")
    hits = near.filter(same).select(*KEY, start.alias("start"), F.size("wanted").alias("length"), "items")
    return there, hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, key columns, n_words, n_hit, items (sorted as strings), contaminated.

    Null and empty texts have no words and no hits; null or wordless items match nothing. Repeated rows each get the
    same result. Item ids that are null count for hits but are not listed. Extra columns are ignored; an empty
    benchmark leaves every document clean.
    """
    there, hits = window_hits(docs, items, window, shingle)
    covered = F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    per_doc = hits.groupBy(*KEY).agg(
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("items").cast("array<string>"))))).alias("items"))
    return there.join(per_doc, list(KEY), "left").select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def op8_benchmark_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bw as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as g
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(s) where len(w) > 0),
dw as (
  select doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') as g
  from d, (select distinct m from bw) as sizes, unnest(range(1, len(w) - m + 2)) as t(s)),
hit as (select doc_id, s, dw.m, item_id from dw join bw on dw.g = bw.g and dw.m = bw.m),
pos as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(s, s + m)) as t(p) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as listed
  from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
