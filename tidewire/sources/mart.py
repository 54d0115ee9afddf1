"""Reading mart tables and conforming frames to a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schemas import MART_SCHEMAS


def read_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table with its declared schema, so no footer is sampled for inference."""
    reader = spark.read
    if name in MART_SCHEMAS:
        reader = reader.schema(MART_SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Project to ``schema``: absent columns become typed defaults, extras are dropped.

    Defaults also replace nulls in columns that are present.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    defaults = defaults or {}
    present = set(df.columns)
    out: list[Column] = []
    for field in schema.fields:
        default = defaults.get(field.name)
        if field.name in present:
            col = F.col(field.name).cast(field.dataType)
            if default is not None:
                col = F.coalesce(col, F.lit(default).cast(field.dataType))
        else:
            col = F.lit(default).cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def widen(df: DataFrame, small: int = 16 << 20) -> DataFrame:
    """Spread a small table over the cores before CPU-heavy work.

    A file of one row group is read by a single task however many cores there
    are. Inputs with more than ``small`` bytes per core come in enough splits
    already and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * small else df
