"""Per-key selection that stays safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key under ``order`` (which must be total).

    Spark places a partial window-group-limit below the shuffle for
    ``row_number() <= n``, so at most ``n`` rows per key leave each map task and
    a hot key never gathers in one reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(_RANK, F.row_number().over(window))
    return ranked.filter(F.col(_RANK) <= n).drop(_RANK)


def ranked_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    """Like :func:`top_per_key`, keeping the rank as a column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def attach_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Group statistics joined back to the rows.

    An aggregate combines map-side and the join back can be split by adaptive
    execution; a window over the key would hold a hot key in a single task.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    renamed = stats.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[c for c in stats.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        part = df[k].eqNullSafe(renamed[f"__k{i}"])
        cond = part if cond is None else cond & part
    return df.join(renamed, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def single_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side of one-row aggregates (each input is a global aggregate)."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.crossJoin(frame)
    return out
