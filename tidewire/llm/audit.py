"""Filter interaction audit: what each filter of a chain removes in every order the filters can be run in.

The texts are read once. A document becomes a mask with one bit per filter it fails, and documents are counted by part
and mask, so at most 32 cells are left per part, however many documents there are. Each cell is then folded over all
orders: a fold along one order carries whether the cell is gone already and notes one struct per step, which weighs the
cell's documents. The structs of a part's cells are merged by sums element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import let, whole

FILTERS = "ABCDE"
BLANKS = "[ \\x09-\\x0D]+"
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails_text(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of the words distinct; over 3 % capitals; a sign of ``#$%&*|``."""
    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(F.size(F.array_distinct(words)) * 100 < n * 50, 2).otherwise(0)

    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return (let(words, of_words) + F.when(capitals * 100 > F.char_length(text) * 3, 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of ``mask``.

    Bit 4 is set for a document whose text a smaller doc_id has as well. Rows of one doc_id are not smaller than each
    other, and a null doc_id is neither smaller nor larger than any. Texts are compared by length and SHA-256. Rows of a
    text held by many are counted by part and label before they meet, so they are few. A document labelled more than
    once is good, or toxic, if one of its labels says so.
    """
    text = whole()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), fails_text(text).alias("mask"),
        F.char_length(text).alias("chars"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = ("chars", "sha", "part", "good", "toxic", "mask")
    rows = rows.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    by_id = rows.groupBy("id", *one).agg(F.count("*").alias("n"))
    first = F.struct(F.col("id").isNull(), "id", "n")
    alike = by_id.groupBy(*one).agg(F.sum("n").alias("n"), F.min(first).alias("first"),
                                    F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    smallest = F.min("first.id").over(Window.partitionBy("chars", "sha"))
    single = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0) + F.col("unnamed")
    split = alike.withColumn("single", single).select("part", F.inline(F.array(*(
        F.struct((F.col("mask") + bit).alias("mask"), n.alias("n"), (n * F.col("good")).alias("good"), (n * F.col("toxic")).alias("toxic"))
        for bit, n in ((0, F.col("single")), (16, F.col("n") - F.col("single")))))))
    return split.filter("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def order_array() -> Column:
    """All orders of the filters, as strings."""
    return F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")


def folded(orders: Column) -> Column:
    """The structs of a cell for every order and step, in one array."""
    steps = f"array<struct<{', '.join(f'{c}: bigint' for c in SUMS)}>>"

    def step(state: Column, number: Column) -> Column:
        fails = F.getbit("mask", number).cast("bigint")
        here = (1 - state["gone"]) * fails
        only = (F.bit_count(F.col("mask").cast("bigint")) == 1).cast("bigint") * fails
        note = F.struct(*(v.cast("bigint").alias(c) for c, v in zip(SUMS, (
            F.col("n") * (1 - state["gone"]) * (1 - fails), F.col("n") * here, F.col("n") * state["gone"] * fails,
            F.col("n") * only, F.col("good") * here, F.col("toxic") * here))))
        return F.struct(F.greatest(state["gone"], fails).alias("gone"), F.concat(state["steps"], F.array(note)).alias("steps"))

    def along(order: Column) -> Column:
        numbers = F.transform(F.split(order, ""), lambda letter: F.ascii(letter) - F.lit(ord(FILTERS[0])))
        start = F.struct(F.lit(0).cast("bigint").alias("gone"), F.array().cast(steps).alias("steps"))
        return F.aggregate(numbers, start, step, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def summed(folds: Column) -> Column:
    """Sums, element by element, of the arrays in an array."""
    def add(total: Column, more: Column) -> Column:
        return F.zip_with(total, more, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in SUMS)))

    return F.aggregate(F.slice(folds, 2, F.size(folds)), folds[0], add)


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order and step of the ``counted`` cells, zeros included; no cells, no rows."""
    orders = order_array()
    per_cell = counted.select("part", folded(orders).alias("fold"))
    per_part = per_cell.groupBy("part").agg(summed(F.collect_list("fold")).alias("fold"))  # at most 32 cells a part
    width = len(FILTERS)
    rows = per_part.select("part", F.posexplode("fold").alias("at", "sums")).select(
        "part", F.element_at(orders, F.expr(f"at div {width}").cast("int") + 1).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"), "sums.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def op12_filter_interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Null texts are empty and fail A alone, and E when repeated; a null lang is part ''. Extra columns are ignored."""
    return audit(cells(docs, labels))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), seen AS (SELECT body, min(id) AS first_id FROM words GROUP BY body
), marks AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN words.id > first_id THEN 'E' ELSE '' END) AS failed
  FROM words JOIN seen USING (body) LEFT JOIN marks ON marks.id = words.id
), cells AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS l FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
  SELECT part, filter_order, step, l, n, good, toxic, failed, contains(failed, l) AS fails,
         list_min(list_transform(string_split(failed, ''), lambda x: CASE WHEN x = '' THEN 9 ELSE position(x IN filter_order) END)) AS gone_at
  FROM cells, steps
), rows AS (
  SELECT part, filter_order, step::INT AS step, l,
         sum(CASE WHEN failed = '' OR gone_at > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN failed <> '' AND gone_at = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails AND gone_at < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failed = l THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN failed <> '' AND gone_at = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN failed <> '' AND gone_at = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM rows
"""
