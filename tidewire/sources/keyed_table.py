"""Merging change batches by key: a fold reduces all rows of a key to one, whatever was folded before.

Batches are plain Parquet partitions ``stream=.../batch=...``. A batch that runs again overwrites its own partition, so a
retry changes nothing; batches of different streams lie apart. The state is the fold over all partitions; to shorten
them, write that state as a batch of a new folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


def merged(fold: Fold, *batches: DataFrame) -> DataFrame:
    """The state that the batches leave, in any order."""
    return fold(reduce(DataFrame.unionByName, batches))


def write_batch(changes: DataFrame, path: str, stream: str, batch_id: int, fold: Fold) -> None:
    """Write a batch, folded by key, as its partition of ``path``."""
    name = hashlib.md5(stream.encode()).hexdigest()[:12]
    fold(changes).write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={name}/batch={batch_id}")


def read_state(spark: SparkSession, path: str, schema: str, fold: Fold) -> DataFrame:
    """The state that all batches under ``path`` leave."""
    return fold(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path))


def last_write_wins(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold that keeps, per key, the row that is last under ``order``."""
    def fold(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        return best.select(*keys, "__row.*").select(*df.columns)

    return fold


def session_fold(df: DataFrame) -> DataFrame:
    """Heartbeats to session state: newest values win, a known user is never lost, the first sighting is kept."""
    order = F.struct("last_ping", "ping_id")
    newest = ("device_os", "app_version", "country", "country_code")

    def last(c: str) -> Column:
        return F.max_by(c, order).alias(c)

    known = F.when(F.col("user_id").isNotNull(), F.struct("user_at", "user_id"))
    return df.groupBy("session_id").agg(
        F.max_by("user_id", known).alias("user_id"), F.max("user_at").alias("user_at"), *[last(c) for c in newest],
        F.lit(True).alias("is_new_install"), F.max("last_ping").alias("last_ping"), F.min("created_at").alias("created_at"),
        F.max_by("ping_id", order).alias("ping_id"))


SESSION_STATE = ("session_id string, user_id string, device_os string, app_version string, country string, country_code string, "
                 "is_new_install boolean, last_ping timestamp_ntz, created_at timestamp_ntz, ping_id bigint, user_at timestamp_ntz")
