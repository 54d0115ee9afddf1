"""Pairs of vectors within a distance, by a tree of pivots that grows where vectors crowd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import bags
from tidewire.session import cut_lineage

LEAF = 512
FAN = 16
DEPTH = 8
WORTH = 0.8  # a cell is cut if that leaves at most this share of its comparisons
SLICE = 2048
EPS = 1e-9


def _distance(x: Column, xx: Column, y: Column, yy: Column) -> Column:
    return F.sqrt(F.greatest(xx + yy - 2 * bags.dot(x, y), F.lit(0.0)))


def cells(points: DataFrame, radius: float, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """``points`` (id, v, vv, ...) with ``cell`` and ``home``: each is at home in one cell and visits all that may hold a point within ``radius``.

    Cells with more than ``leaf`` at home are cut by ``fan`` of their points as pivots: a point goes home to its nearest
    pivot, and visits each pivot that is less than two radii farther than the nearest. A cell that would not get cheaper
    by the cut stays whole. A row meets only the pivots of its own cell.
    """
    open_ = points.withColumns({"cell": F.lit(0).cast("bigint"), "home": F.lit(True)})
    kept = points.columns
    done = None
    for level in range(DEPTH):
        open_ = cut_lineage(open_)
        crowded = open_.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).filter(F.col("homes") > leaf)
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(level)), "id")
        picked = open_.filter("home").join(crowded.select("cell"), "cell").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= fan)
        pivots = picked.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("r", "v", "vv"))).alias("pivots"))
        far = F.transform("pivots", lambda p: _distance(F.col("v"), F.col("vv"), p["v"], p["vv"]))
        placed = open_.join(pivots, "cell").withColumn("far", far).withColumn("least", F.array_min("far"))
        reach = F.filter(F.sequence(F.lit(0), F.size("far") - 1), lambda i: F.get("far", i) - F.col("least") <= 2 * radius + EPS)
        own = F.array_position("far", F.col("least")).cast("int") - 1
        spread = placed.select(*kept, "cell", "home", own.alias("own"), F.explode(reach).alias("at"))
        spread = cut_lineage(spread.select(*kept, F.col("cell").alias("from"), (F.col("cell") * fan + F.col("at") + 1).alias("cell"),
                                           (F.col("home") & (F.col("own") == F.col("at"))).alias("home")))
        work = spread.groupBy("from", "cell").agg((F.count_if("home") * F.count("*")).alias("w")).groupBy("from").agg(F.sum("w").alias("after"))
        before = crowded.select(F.col("cell").alias("from"), (F.col("homes") * F.col("rows")).alias("before"))
        worth = cut_lineage(work.join(before, "from").filter(F.col("after") <= F.col("before") * WORTH).select("from"))
        whole = open_.join(worth.withColumnRenamed("from", "cell"), "cell", "left_anti").select(*kept, "cell", "home")
        done = whole if done is None else done.unionByName(whole)
        open_ = spread.join(worth, "from", "left_semi").drop("from")
        if worth.isEmpty():
            return done
    return done.unionByName(open_.select(*kept, "cell", "home"))


def pairs_within(points: DataFrame, radius: float, label: str | None = None, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(a, b, d), a < b: all pairs of points (id, v) at Euclidean distance of at most ``radius``, each once.

    ``label`` names a column in which the two must differ. The lower id reports a pair, in its home cell. Large cells
    are dealt in slices, so no task holds one.
    """
    extra = [label] if label else []
    rows = points.select("id", *extra, F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("vv", bags.dot(F.col("v"), F.col("v")))
    placed = cut_lineage(cells(rows, radius, leaf, fan))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / SLICE).cast("int").alias("slices"))
    sized = placed.join(sizes, "cell")
    homes = sized.filter("home").select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.struct("id", *extra, "v", "vv").alias("x"))
    others = sized.select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.struct("id", *extra, "v", "vv").alias("y"))
    met = homes.join(others.filter("slice >= 0"), ["cell", "slice"]).filter(F.col("x.id") < F.col("y.id"))
    if label:
        met = met.filter(F.col(f"x.{label}") != F.col(f"y.{label}"))
    d = _distance(F.col("x.v"), F.col("x.vv"), F.col("y.v"), F.col("y.vv"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.alias("d")).filter(F.col("d") <= radius + EPS)
