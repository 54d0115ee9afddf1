"""Joins against small reference lists, and image reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import haversine_km
from tidewire.sources.mart import estimated_bytes

# A reference list is folded into one array per row only up to this size.
LIST_BYTES = 4 << 20


def _as_list(df: DataFrame, *columns: str) -> DataFrame:
    """A small frame as one row holding an array; refused when it is not small."""
    if estimated_bytes(df) > LIST_BYTES:
        raise ValueError("the reference list is too large to be shipped to every task")
    return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__list"))


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """Name and distance of the nearest place (place_id, name, lat, lon) for every point (lat, lon)."""
    df = points.crossJoin(F.broadcast(_as_list(places, "place_id", "name", F.col("lat").alias("plat"), F.col("lon").alias("plon"))))
    far = F.transform("__list", lambda p: F.struct(
        haversine_km(F.col("lat"), F.col("lon"), p["plat"], p["plon"]).alias("km"), p["place_id"].alias("place_id"), p["name"].alias("name")))
    return df.withColumn("__near", F.array_min(far)).select(*points.columns, "__near.name", "__near.km")


def reused_images(df: DataFrame, image: str) -> DataFrame:
    """Rows whose image also serves another URL, with the number of URLs and sources that use it."""
    pairs = df.filter(F.coalesce(F.col(image), F.lit("")) != "").select(image, "url", "source_name").distinct()
    urls = pairs.select(image, "url").distinct().groupBy(image).agg(F.count("*").alias("urls"))
    sources = pairs.select(image, "source_name").distinct().groupBy(image).agg(F.count("*").alias("sources"))
    shared = urls.filter("urls > 1").join(sources, image)
    return df.join(shared, image)


def _parts(text: Column, lengths: Column) -> Column:
    """Distinct substrings of a text that have one of the given lengths."""
    fitting = F.filter(lengths, lambda n: n <= F.length(text))
    return F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n)))))


def _holding(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part) of the distinct texts (column text) and parts (column part) where the text holds the part.

    Texts are cut into substrings of the lengths that occur among the parts, and the two are joined on equal strings, so
    no text meets all parts.
    """
    lengths = parts.agg(F.sort_array(F.collect_set(F.length("part"))).alias("lengths"))
    cut = texts.crossJoin(F.broadcast(lengths)).select("text", F.explode(_parts(F.col("text"), F.col("lengths"))).alias("part"))
    return cut.join(parts, "part").select("text", "part")


def canonical_names(names: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Canonical form of names: an equal known key first, else the longest key that contains or is contained in the name."""
    keyed = known.groupBy(F.lower("key").alias("__key")).agg(
        F.min(F.struct((-F.length("key")).alias("n"), "key", "canonical")).alias("first")).filter("__key IS NOT NULL")
    texts = names.select(F.lower(F.col(name)).alias("__low")).filter("__low IS NOT NULL").distinct()
    said, keys = texts.select(F.col("__low").alias("text")), keyed.select(F.col("__key").alias("part"))
    inside = _holding(said, keys).select(F.col("text").alias("__low"), F.col("part").alias("__key"))
    around = _holding(keys.toDF("text"), said.toDF("part")).select(F.col("part").alias("__low"), F.col("text").alias("__key"))
    order = F.struct((F.col("__key") != F.col("__low")).alias("other"), "first")
    best = inside.unionByName(around).join(keyed, "__key").groupBy("__low").agg(F.min(order).alias("__best"))
    return names.withColumn("__low", F.lower(F.col(name))).join(best, "__low", "left").select(
        *names.columns, F.col("__best.first.canonical").alias("canonical"))
