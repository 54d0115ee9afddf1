"""Iterative graph operators on edge frames, with reliable checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators import blocks
from tidewire.operators import simjoin as sj
from tidewire.session import cut_lineage


def dropped_by_first_kept(edges: DataFrame) -> DataFrame:
    """Vertices that a pass in order would drop because an earlier kept vertex is adjacent.

    ``edges`` has (early, late). A vertex without an undecided earlier neighbour
    is kept, its later neighbours are dropped, and edges of dropped vertices
    vanish; vertices left without edges are kept.
    """
    dropped = None
    edges = cut_lineage(edges.select("early", "late").distinct())
    while not edges.isEmpty():
        late = edges.select("late").distinct()
        roots = edges.select("early").distinct().join(late, F.col("early") == F.col("late"), "left_anti")
        gone = cut_lineage(edges.join(roots, "early", "left_semi").select(F.col("late").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = cut_lineage(
            edges.join(gone, F.col("early") == F.col("id"), "left_anti").join(gone, F.col("late") == F.col("id"), "left_anti")
        )
    if dropped is None:
        return edges.select(F.col("early").alias("id"))
    return dropped


def edge_leaders(edges: DataFrame) -> DataFrame:
    """(id, leader) of every dropped vertex: its earliest kept neighbour. ``edges``: (early, late, early_ord)."""
    edges = cut_lineage(edges)
    gone = dropped_by_first_kept(edges)
    kept_side = edges.join(gone, F.col("early") == F.col("id"), "left_anti")
    return kept_side.groupBy(F.col("late").alias("id")).agg(F.min_by("early", "early_ord").alias("leader"))


def set_leaders(
    df: DataFrame, id_col: str, tokens: str, t: float, order: Column | None = None, pairs: bool = False, scope: str | None = None
) -> DataFrame:
    """(id, leader, similarity): who leads each row when rows join the first earlier leader with Jaccard >= t.

    Leaders and rows without tokens lead themselves. The result equals the pass
    over the rows in ``order``. Before any pairs are made, sets that come first
    in all their signature groups are settled as leaders and what they cover is
    taken out, so a mass of near-copies never pairs with itself. Long sets (without ``pairs``) meet block by block
    instead, see ``_block_leaders``; sets that differ in the column ``scope`` share no token.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens"),
                     (order if order is not None else F.col(id_col)).alias("o"), *([F.col(scope).alias("scope")] if scope else []))
    key = F.md5(F.array_join(F.array_sort("tokens"), "\x1f"))
    if not pairs:
        return _led(rows, key, *_block_leaders(rows, key, t, "scope" if scope else None))
    sets = cut_lineage(sj.distinct_sets(rows, "id", "tokens", F.col("o")))
    sigs = cut_lineage(sj.signatures(sets, t, pairs))
    # one star round
    first = sigs.groupBy("sig").agg(F.min("ord").alias("first"))
    seen = sigs.join(first, "sig").select("set_id", "ord", "size", F.col("first.id").alias("head"), (F.col("ord") == F.col("first")).alias("leads"))
    sure = seen.groupBy("set_id").agg(F.bool_and("leads").alias("sure")).filter("sure").select(F.col("set_id").alias("head"))
    sure = cut_lineage(sure)
    star = seen.filter(~F.col("leads")).join(sure, "head", "left_semi").select(
        F.col("head").alias("early"), F.col("set_id").alias("late")).distinct()
    star_edges = cut_lineage(sj.verify(star, sets, t))
    settled = star_edges.select(F.col("late").alias("set_id")).unionByName(sure.select(F.col("head").alias("set_id"))).distinct()
    settled = cut_lineage(settled)
    # what is left is paired
    open_sigs = sigs.join(settled, "set_id", "left_anti")
    open_edges = cut_lineage(sj.verify(sj._candidates(open_sigs, open_sigs, t, True), sets, t))
    open_gone = dropped_by_first_kept(open_edges)
    open_kept = open_edges.join(open_gone, F.col("early") == F.col("id"), "left_anti")
    # covered sets may have an earlier leader among those settled later
    late_leaders = open_sigs.join(open_gone.select(F.col("id").alias("set_id")), "set_id", "left_anti")
    covered = sigs.join(star_edges.select(F.col("late").alias("set_id")).distinct(), "set_id", "left_semi")
    cross = sj.verify(sj._candidates(late_leaders, covered, t, True), sets, t)
    edges = star_edges.unionByName(open_kept.select(*star_edges.columns)).unionByName(cross)
    best = edges.groupBy(F.col("late").alias("set_id")).agg(
        F.min_by(F.struct("early", "similarity"), "early_ord").alias("b"))
    return _led(rows, key, sets.select("key", "set_id"), best)


def _led(rows: DataFrame, key: Column, sets: DataFrame, best: DataFrame) -> DataFrame:
    """Rows with the leader of their set: ``sets`` has (key, set_id), ``best`` (set_id, b: early, similarity) of sets that do not lead."""
    led = sets.join(best, "set_id", "left").select(
        "key", F.coalesce("b.early", "set_id").alias("leader"), F.coalesce("b.similarity", F.lit(1.0)).alias("similarity"))
    keyed = rows.select("id", key.alias("key"), F.size("tokens").alias("n"))
    return keyed.join(led, "key", "left").select(
        "id", F.when(F.col("n") > 0, F.col("leader")).otherwise(F.col("id")).alias("leader"),
        F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def _block_leaders(rows: DataFrame, key: Column, t: float, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """Sets and leaders of those that do not lead, for ``_led``.

    Of the pairs found in the blocks only the earliest neighbour of each set is kept. A set without an earlier one leads,
    and a set whose earliest neighbour leads belongs to it. The few others are compared again, with the leaders and with
    one another.
    """
    rank = F.struct(F.col("o"), F.col("id"))
    carried = [F.first(scope).alias("scope")] if scope else []
    sets = rows.filter(F.size("tokens") > 0).groupBy(key.alias("key")).agg(
        F.min(rank).alias("id"), F.first(blocks.codes(F.col("tokens"))).alias("codes"), *carried)
    sets = cut_lineage(sets)
    found = blocks.similar(sets.select("id", "codes", *([scope] if scope else [])), t, False, scope, lambda found: found.groupBy(
        F.greatest("a", "b").alias("late")).agg(F.min(F.struct(F.least("a", "b").alias("early"), "similarity")).alias("b")))
    first = cut_lineage(found.groupBy("late").agg(F.min("b").alias("b")))
    late = first.select("late", F.col("b.early").alias("early"))
    behind = late.join(late.select(F.col("late").alias("early")), "early", "left_semi").select(F.col("late").alias("id"))
    behind = cut_lineage(behind)
    settled = first.join(behind.withColumnRenamed("id", "late"), "late", "left_anti")
    if not behind.isEmpty():
        open_ = cut_lineage(sets.join(behind, "id", "left_semi").select("id", "codes"))
        leaders = sets.join(first.select(F.col("late").alias("id")), "id", "left_anti").select("id", "codes")
        met = cut_lineage(blocks.between(open_, leaders, t).unionByName(blocks.similar(open_, t, False)))
        edges = met.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"), "similarity")
        gone = dropped_by_first_kept(edges)
        kept = edges.join(gone, F.col("early") == F.col("id"), "left_anti")
        settled = settled.unionByName(kept.groupBy("late").agg(F.min(F.struct("early", "similarity")).alias("b")))
    best = settled.select(F.col("late.id").alias("set_id"), F.struct(F.col("b.early.id").alias("early"), F.col("b.similarity").alias("similarity")).alias("b"))
    return sets.select("key", F.col("id.id").alias("set_id")), best


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the lowest id reachable, by alternating large-star and small-star (Kiveris et al., 2014)."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut_lineage(small)
        mark = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()
