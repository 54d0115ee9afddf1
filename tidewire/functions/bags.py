"""Counting the items of an array inside its row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import let


def counted(items: Column) -> Column:
    """Array of (term, n) for the distinct items, by run lengths of the sorted array."""

    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.get(s, i - 1) != F.coalesce(F.get(s, i - 2), F.lit("")))
        )
        pairs = let(starts, lambda st: F.transform(st, lambda i, j: F.struct(
            F.get(s, i - 1).alias("term"), (F.coalesce(F.get(st, j + 1), size + 1) - i).alias("n"))))
        return F.when(size > 0, pairs).otherwise(F.array().cast("array<struct<term:string,n:int>>"))

    # sort_array compares natively; array_sort would interpret a comparator for every two items
    return let(F.sort_array(items), runs)


def top_terms(items: Column, k: int) -> Column:
    """The ``k`` most frequent items, ties in item order."""
    ranked = F.sort_array(F.transform(counted(items), lambda c: F.struct((-c["n"]).alias("r"), c["term"].alias("term"))))
    return F.transform(F.slice(ranked, 1, k), lambda c: c["term"])


def best_n(scored: Column, n: int) -> Column:
    """First ``n`` structs by their leading field descending, then by the next fields ascending."""
    flipped = F.array_sort(F.transform(scored, lambda s: F.struct((-s["score"]).alias("r"), s.alias("s"))))
    return F.transform(F.slice(flipped, 1, n), lambda f: f["s"])


def unit_weights(terms: Column) -> Column:
    """Array of (term, weight) scaled to length one, from an array of (term, n)."""
    norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["n"].cast("double") * t["n"]))
    return let(norm, lambda z: F.transform(
        terms, lambda t: F.struct(t["term"].alias("term"), (t["n"] / z).alias("weight"))))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays; zero when the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; zero when the lengths differ or a side has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.least(F.greatest(dot(a, b) / norms, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
