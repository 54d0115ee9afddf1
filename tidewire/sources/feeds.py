"""Readers that turn feeds, catalogues and trees into article and bridge rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.operators.keyed import top_per_key
from tidewire.schemas import SOURCE_CATALOGUE

# Shapes of the feeds.
RSS_ITEM = ("title string, link string, description string, pubDate string, "
            "enclosure struct<_url: string, _type: string>, guid string")
SITEMAP_URL = "loc string, lastmod string, publication_date string"
ARTICLE_LIST = ("articles array<struct<url: string, title: string, seendate: string, socialimage: string, domain: string, "
                "language: string, sourcecountry: string>>")
CLAIM_LIST = ("claims array<struct<text: string, claimant: string, claimDate: string, claimReview: array<struct<"
              "publisher: struct<name: string, site: string>, url: string, title: string, textualRating: string, "
              "reviewDate: string, languageCode: string>>>>")
SEARCH_LIST = "query struct<search: array<struct<title: string, pageid: bigint, snippet: string, timestamp: string>>>"


def flatten_sources(catalogue: DataFrame) -> DataFrame:
    """Nested country -> sources catalogue as one row per source, languages joined."""
    return (
        catalogue.select(F.explode("countries").alias("c"))
        .select("c.country", "c.country_code", F.explode("c.sources").alias("s"))
        .select("country", "country_code", "s.name", "s.url", "s.category", "s.type", F.array_join("s.language", ",").alias("language"), "s.rank")
    )


def read_catalogue(spark, path: str) -> DataFrame:
    return flatten_sources(spark.read.schema(SOURCE_CATALOGUE).option("multiLine", True).json(path))


def explode_tree(nodes: DataFrame, value: str, fields: str, key: str = "id") -> DataFrame:
    """A JSON object keyed by id, held as text, as one row per entry with the given fields."""
    entries = nodes.select(F.explode(F.from_json(value, f"map<string, struct<{fields}>>")).alias(key, "entry"))
    return entries.select(key, "entry.*")


def explode_bridge(nodes: DataFrame, value: str, outer: str, inner: str, field: str) -> DataFrame:
    """A two-level keyed tree (user -> article -> value) as (outer, inner, value) rows."""
    level = nodes.select(F.explode(F.from_json(value, "map<string, map<string, string>>")).alias(outer, "m"))
    return level.select(outer, F.explode("m").alias(inner, field))


def _no_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&[a-z]+;", ""))


def feed_items(items: DataFrame, feed_url: Column, as_of, provider: str = "rss", keep: tuple[str, ...] = ()) -> DataFrame:
    """RSS items (RSS_ITEM columns) as articles; items without title or link are left out."""
    title, link = _no_tags(F.col("title")), F.trim("link")
    df = items.select(
        *keep, link.alias("url"), title.alias("title"), F.coalesce(_no_tags(F.col("description")), F.lit("")).alias("summary"),
        F.coalesce(F.col("enclosure._url"), F.lit("")).alias("image_url"), F.lit("general").alias("category"),
        dates.parse_any_date(F.col("pubDate"), as_of).alias("published_at"), feed_url.alias("source_url"), F.lit(provider).alias("provider"))
    return df.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def read_feed_files(spark, path: str, as_of) -> DataFrame:
    """RSS files read with the XML source, one row per item element."""
    items = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    return feed_items(items, F.input_file_name(), as_of)


def parse_feed_documents(docs: DataFrame, xml: str, as_of) -> DataFrame:
    """RSS documents held in a column: item elements are cut out and parsed one by one; other columns stay."""
    items = docs.select("*", F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item>.*?</item>"), F.lit(0))).alias("__item"))
    rest = [c for c in docs.columns if c != xml]
    parsed = items.select("*", F.from_xml("__item", RSS_ITEM).alias("__i")).select(*rest, "__i.*")
    return feed_items(parsed, F.lit(""), as_of, keep=tuple(rest))


def read_sitemap(spark, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "url").schema(SITEMAP_URL).load(path)
    return rows.select(F.col("loc").alias("url"), F.coalesce("publication_date", "lastmod").alias("date_hint"))


def parse_sitemap_documents(docs: DataFrame, xml: str) -> DataFrame:
    rows = docs.select("*", F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>.*?</url>"), F.lit(0))).alias("__u"))
    parsed = rows.select(*[c for c in docs.columns if c != xml], F.from_xml("__u", SITEMAP_URL).alias("u"))
    return parsed.select(*[c for c in docs.columns if c != xml], F.trim("u.loc").alias("url"),
                         F.coalesce("u.publication_date", "u.lastmod").alias("date_hint"))


def parse_article_list(docs: DataFrame, body: str) -> DataFrame:
    """Article-list JSON with compact dates (yyyyMMdd'T'HHmmss'Z' or digits only)."""
    rows = docs.select(F.explode(F.from_json(body, ARTICLE_LIST)["articles"]).alias("a"))
    digits = F.regexp_replace("a.seendate", "[^0-9]", "")
    return rows.select(
        "a.url", "a.title", F.col("a.socialimage").alias("image_url"), F.col("a.domain").alias("source_name"), F.lower("a.language").alias("language"),
        F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).alias("published_at")).filter((F.col("url") != "") & (F.col("title") != ""))


def parse_claims(docs: DataFrame, body: str) -> DataFrame:
    """Fact-check JSON: one row per claim and review."""
    rows = docs.select(F.explode(F.from_json(body, CLAIM_LIST)["claims"]).alias("c"))
    rows = rows.select("c.text", "c.claimant", F.explode("c.claimReview").alias("r"))
    return rows.select(
        F.col("r.url").alias("url"), F.coalesce("r.title", "text").alias("title"),
        F.concat(F.lit("Claim: "), "text", F.lit(" | Rating: "), F.coalesce("r.textualRating", F.lit(""))).alias("summary"),
        "claimant", F.col("r.publisher.name").alias("publisher"), F.col("r.textualRating").alias("rating"),
        F.col("r.languageCode").alias("language"), F.col("r.reviewDate").try_cast("timestamp").alias("published_at"))


def parse_search(docs: DataFrame, body: str, base_url: str) -> DataFrame:
    """Encyclopedia search JSON: one row per hit, tags stripped from the snippet; other columns stay."""
    rest = [c for c in docs.columns if c != body]
    rows = docs.select(*rest, F.explode(F.from_json(body, SEARCH_LIST)["query"]["search"]).alias("s"))
    return rows.select(
        *rest, F.concat(F.lit(base_url), F.replace("s.title", F.lit(" "), F.lit("_"))).alias("url"), "s.title",
        tx.strip_tags(F.col("s.snippet")).alias("summary"), F.col("s.timestamp").try_cast("timestamp").alias("published_at"))


def discover(providers: dict[str, DataFrame], per_provider: int = 50, ties: Sequence[str] = ()) -> DataFrame:
    """Union of provider frames, newest ``per_provider`` of each. Rows alike in time and URL are ordered by the columns ``ties``."""
    out = None
    for name, df in providers.items():
        part = df.withColumn("provider", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return top_per_key(out, ["provider"], [F.desc_nulls_last("published_at"), F.asc("url"), *map(F.asc, ties)], per_provider)


def repaired(df: DataFrame, as_of, default_source: str = "exclusive") -> DataFrame:
    """Write-time repairs: source name, placeholder image seeded by URL and title, status and date."""
    image = F.coalesce("image_url", F.lit(""))
    seed = F.crc32(F.concat(F.col("url"), F.col("title")))
    placeholder = F.concat(F.lit("https://placehold.co/600x400/EEE/31343C?text="), F.url_encode("category"), F.lit("+"), seed)
    return df.withColumns({
        "source_name": F.coalesce(F.nullif(F.trim("source_name"), F.lit("")), F.lit(default_source)),
        "image_url": F.when((image == "") | image.contains("bing.com/images/search"), placeholder).otherwise(image),
        "status": F.when(F.col("status").isin("published", "draft", "archived"), F.col("status")).otherwise("published"),
        "published_at": F.coalesce("published_at", F.lit(as_of).cast("timestamp_ntz")),
    })


def saved_documents(df: DataFrame) -> DataFrame:
    """Rows with URL and title as stored documents: host as source name, score 0.85 unless given."""
    ok = df.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    return ok.withColumns({"source_name": ux.domain_or_url(F.col("url")), "source_score": F.coalesce("source_score", F.lit(0.85)),
                           "status": F.coalesce("status", F.lit("published"))})


def source_score(raw: Column) -> Column:
    """Two decimals, kept within 0.00 and 0.99."""
    return F.least(F.greatest(F.round(raw, 2), F.lit(0.0)), F.lit(0.99)).cast("decimal(3,2)")


def upsert_by_url_language(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows updated by new rows with the same URL and language; the stored id stays, new rows get a derived id."""
    keys = ["url", "language"]
    values = [c for c in new.columns if c not in (*keys, "id")]
    left = old.select(*keys, F.col("id").alias("__id"), *[F.col(c).alias(f"__o_{c}") for c in values])
    right = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values], F.lit(True).alias("__new"))
    out = left.join(right, keys, "full")
    fresh = F.coalesce("__new", F.lit(False))
    return out.select(
        F.coalesce("__id", F.concat(F.lit("article_"), F.sha2(F.concat_ws("|", *keys), 256))).alias("id"), *keys,
        *[F.when(fresh, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in values],
        (F.col("__id").isNotNull() & fresh).alias("updated"))
