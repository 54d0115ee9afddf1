"""Column and frame helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import cut_lineage


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffle files nothing refers to any more: it does so once the driver's objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Sortable, never-null key of a document: (id is present, id, hash of the text)."""
    return [
        F.col(id_col).isNotNull().alias("kn"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("kd"),
        F.xxhash64(whole(text_col)).alias("kh"),
    ]


KEY = ("kn", "kd", "kh")


def ordered_neighbours(keys: DataFrame, carried: Sequence[str], rows_per_part: int = 100_000) -> DataFrame:
    """Each distinct key with its cyclic successor, without gathering all keys in one task.

    ``keys`` has KEY and ``carried`` columns. Keys are dealt into ranges; a window inside each range finds the
    successor, and the last of a range takes the first of the next one from a table with one row per range.
    Returns (kn, kd, kh, carried..., next_kn, next_kd, next_kh). A single key succeeds itself.
    """
    keys = cut_lineage(keys.groupBy(*KEY).agg(*(F.min(c).alias(c) for c in carried)))
    parts = max(1, -(-keys.count() // rows_per_part))
    ranged = cut_lineage(keys.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()))
    me = F.struct(*KEY)
    firsts = ranged.groupBy("part").agg(F.min(me).alias("first"))
    order = Window.orderBy("part")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("after"))
    inside = ranged.withColumn("succ", F.lead(me).over(Window.partitionBy("part").orderBy(*KEY)))
    return inside.join(F.broadcast(firsts), "part").select(
        *KEY, *carried, *(F.coalesce(F.col("succ"), F.col("after"))[k].alias(f"next_{k}") for k in KEY))


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, rows_per_part: int = 100_000) -> DataFrame:
    """Gapless numbers from 0 within each group, also when a few groups hold all rows.

    Rows of a group are dealt over slices by the hash of ``order``; a table with one row per group and slice gives
    the first number of each slice, and a window numbers the rows inside a slice. Rows equal in ``groups`` and
    ``order`` share a slice and may swap numbers among themselves. The rows are written once, so that all passes
    over them agree and no earlier work is repeated.
    """
    df = cut_lineage(df)
    slices = max(1, -(-df.count() // rows_per_part))
    sliced = df.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = sliced.groupBy(*groups, "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"at_{g}") for g in groups), F.col("slice").alias("at_slice"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_number"))
    same = F.col("slice") == F.col("at_slice")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"at_{g}"))
    inside = Window.partitionBy(*groups, "slice").orderBy(*order)
    return (
        sliced.withColumn("in_slice", F.row_number().over(inside) - 1)
        .join(starts, same)
        .withColumn(name, (F.col("first_number") + F.col("in_slice")).cast("long"))
        .select(*df.columns, name)
    )
