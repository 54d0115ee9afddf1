"""The news mart: filtered, joined, sorted and paged feeds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators.keyed import top_per_key
from tidewire.sources.mart import estimated_bytes

MAX_PAGE = 100


@dataclass(frozen=True)
class FeedQuery:
    category: str | None = None
    language: str | None = None
    exclude_url: str | None = None
    search: str | None = None
    related: bool = False
    all_statuses: bool = False
    sort: str = "published_at"
    descending: bool = True
    page: int = 1
    limit: int = 20

    @property
    def size(self) -> int:
        return min(MAX_PAGE, max(1, self.limit))

    @property
    def offset(self) -> int:
        return (max(1, self.page) - 1) * self.size


def contains_text(term: str, *cols: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    needle = F.lit(term.lower())
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return out


def feed_filter(news: DataFrame, q: FeedQuery) -> DataFrame:
    if q.related and (not q.category or q.category.lower() == "all" or not q.language):
        raise ValueError("related news requires both category and language")
    df = news
    if not q.all_statuses:
        df = df.filter(F.col("status") == "published")
    if q.category:
        df = df.filter(F.col("category") == q.category)
    if q.language:
        df = df.filter(F.col("language") == q.language)
    if q.related and q.exclude_url:
        df = df.filter(F.col("url").isNull() | (F.col("url") != q.exclude_url))
    if q.search:
        df = df.filter(contains_text(q.search, "title", "summary"))
    return df


def small_side(dim: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast a dimension only when the optimizer's size estimate is under the limit."""
    return F.broadcast(dim) if estimated_bytes(dim) <= limit_bytes else dim


def with_dimensions(news: DataFrame, categories: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Category names, and source name/url for rows that only carry a source id."""
    out = news.join(small_side(categories), "category_id", "left")
    if sources is not None:
        out = out.join(small_side(sources), "source_id", "left")
        out = out.withColumn("source_name", F.coalesce("source_name", F.col("source_id").cast("string")))
    return out


def view_counts(news: DataFrame, views: DataFrame, key: str = "id", ref: str = "article_id") -> DataFrame:
    """Views per article, zero when there are none; views combine before they move."""
    counts = views.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("views_count"))
    return news.join(counts, key, "left").withColumn("views_count", F.coalesce("views_count", F.lit(0)))


SORTS = ("published_at", "date", "created_at", "title", "views", "source", "category")


def sort_columns(sort: str, descending: bool, key: str = "id") -> list[Column]:
    """Whitelisted sort; anything unknown sorts by publication time. The key makes the order total."""
    name = {"date": "published_at", "views": "views_count", "source": "source_name"}.get(sort, sort)
    if sort not in SORTS:
        name = "published_at"
    first = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_first()
    return [first, F.col("published_at").desc_nulls_last(), F.col(key)]


def page_of(df: DataFrame, order: Sequence[Column], page: int, limit: int) -> DataFrame:
    q = FeedQuery(page=page, limit=limit)
    return df.orderBy(*order).offset(q.offset).limit(q.size)


def page_after(df: DataFrame, after: datetime, after_id, limit: int, key: str = "id") -> DataFrame:
    """Key-set paging, newest first: the rows after (time, id), however deep, with no rows skipped over."""
    later = F.lit(after).cast(df.schema["published_at"].dataType)
    rest = (F.col("published_at") < later) | ((F.col("published_at") == later) & (F.col(key) > F.lit(after_id)))
    return df.filter(rest).orderBy(F.desc("published_at"), F.col(key)).limit(min(MAX_PAGE, max(1, limit)))


def page_info(df: DataFrame, page: int, limit: int) -> DataFrame:
    q = FeedQuery(page=page, limit=limit)
    return df.agg(F.count("*").alias("total")).select(
        F.lit(max(1, page)).cast("bigint").alias("page"), F.lit(q.size).cast("bigint").alias("page_size"), "total",
        F.ceil(F.col("total") / q.size).cast("bigint").alias("total_pages"),
    )


def feed(news: DataFrame, q: FeedQuery, categories: DataFrame, sources: DataFrame, views: DataFrame) -> DataFrame:
    """One feed page. Unless the sort needs view counts, only the page's own views are counted."""
    df = feed_filter(news, q)
    if q.sort == "views":
        paged = page_of(view_counts(df, views), sort_columns(q.sort, q.descending), q.page, q.limit)
    else:
        cut = page_of(df, sort_columns(q.sort, q.descending), q.page, q.limit)
        # the page holds at most MAX_PAGE rows, so its keys are safe to broadcast
        mine = views.join(F.broadcast(cut.select(F.col("id").alias("article_id"))), "article_id", "left_semi")
        paged = view_counts(cut, mine)
    return with_dimensions(paged, categories, sources)


def source_filter(
    sources: DataFrame, status: str | None = "published", country: str | None = None, language: str | None = None,
    search: str | None = None, not_crawled_since: datetime | None = None,
) -> DataFrame:
    df = sources
    for col, value in (("status", status), ("country", country), ("language", language)):
        if value is not None:
            df = df.filter(F.col(col) == value)
    if search:
        df = df.filter(contains_text(search, "name", "url"))
    if not_crawled_since is not None:
        cut = F.lit(not_crawled_since).cast(df.schema["last_crawled"].dataType)
        df = df.filter(F.col("last_crawled").isNull() | (F.col("last_crawled") < cut))
    return df


def policy_filter(articles: DataFrame, language: str, as_of: datetime) -> DataFrame:
    """Has a publisher, matches the reader's language and is not known to be older than three months."""
    named = F.lit(False)
    for c in ("source_name", "author"):
        named = named | F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    lang = F.lower(F.trim("language")) == language.lower()
    return articles.filter(named & lang & dates.within(F.col("published_at"), as_of, months=3))


def fresh_feed(articles: DataFrame, as_of: datetime) -> DataFrame:
    current = dates.is_current_event(F.col("event_type"), F.col("category"))
    return articles.filter(dates.fresh_for_feed(F.col("published_at"), current, as_of))


def at_least_fresh(articles: DataFrame, as_of: datetime, cls: str = "recent", include_unknown: bool = False):
    order = dates.freshness_order(F.col("published_at"), as_of)
    ok = order <= dates.FRESHNESS_ORDER.index(cls)
    if include_unknown:
        ok = ok | F.col("published_at").isNull()
    return articles.filter(ok)


def fresher_order(as_of: datetime, key: str = "id") -> list[Column]:
    """Freshness class first, then the later date; unknown dates come last."""
    return [dates.freshness_order(F.col("published_at"), as_of), F.desc_nulls_last("published_at"), F.col(key)]


def user_list(users: DataFrame, search: str | None = None, role: str | None = None) -> DataFrame:
    df = users
    if search:
        df = df.filter(contains_text(search, "email", "display_name"))
    if role:
        df = df.filter(F.col("role") == role)
    return df


# --- joins ------------------------------------------------------------------------


def bridged_articles(bridge: DataFrame, news: DataFrame, published_only: bool = False) -> DataFrame:
    """Articles a reader saved or read."""
    kept = news.filter(F.col("status") == "published") if published_only else news
    return bridge.join(kept, F.col("article_id") == F.col("id"))


def comments_with_titles(comments: DataFrame, news: DataFrame, search: str | None = None) -> DataFrame:
    df = comments.filter(contains_text(search, "text", "user_name")) if search else comments
    titles = news.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    return df.join(titles, "article_id", "left")


def reports_with_titles(reports: DataFrame, news: DataFrame, search: str | None = None) -> DataFrame:
    titles = news.select(
        F.col("id").alias("article_id"), F.col("title").alias("article_title"),
        F.col("language").alias("article_language"),
    )
    df = reports.join(titles, "article_id", "left")
    if search:
        df = df.filter(contains_text(search, "article_id", "article_title", "reported_by_name", "reason"))
    return df


def resolve_refs(refs: DataFrame, news: DataFrame, ref: str = "ref") -> DataFrame:
    """Article id of a reference given as an id or as a URL: two equi-joins over the distinct references."""
    by_id = news.select(F.col("id").cast("string").alias(ref), F.col("id").alias("__by_id"))
    by_url = news.groupBy(F.col("url").alias(ref)).agg(F.min("id").alias("__by_url"))
    known = (
        refs.select(ref).distinct().join(by_id, ref, "left").join(by_url, ref, "left")
        .select(ref, F.coalesce("__by_id", "__by_url").alias("article_id"))
    )
    return refs.join(known, ref, "left")


def unknown_urls(candidates: DataFrame, *known: DataFrame, key: str = "url_key") -> DataFrame:
    """Candidates in none of the known sets (crawled, blacklisted, stored)."""
    out = candidates
    for side in known:
        out = out.join(side.select(key).distinct(), key, "left_anti")
    return out


def due_for_recrawl(urls: DataFrame, crawls: DataFrame, as_of: datetime, key: str, at: str, hours: int = 1):
    """Never crawled, or last crawled more than ``hours`` ago."""
    last = crawls.groupBy(key).agg(F.max(at).alias("last_crawl"))
    cut = F.lit(as_of - timedelta(hours=hours)).cast(crawls.schema[at].dataType)
    return urls.join(last, key, "left").filter(F.col("last_crawl").isNull() | (F.col("last_crawl") < cut))


def related_articles(articles: DataFrame, cluster: str, n: int = 6) -> DataFrame:
    """For every article up to ``n`` others: its cluster first, then its category and language, newest first.

    Only the newest n+1 of a cluster and 2n+1 of a (category, language) can ever
    be chosen (the extra places cover the article itself and cluster mates), so
    each article meets a bounded list and no group is paired with itself.
    """
    newest = [F.desc_nulls_last("published_at"), F.col("id")]
    mates = top_per_key(articles.filter(F.col(cluster).isNotNull()), [cluster], newest, n + 1)
    fill = top_per_key(articles, ["category", "language"], newest, 2 * n + 1)

    def offered(side: DataFrame, keys: list[str], tier: int) -> DataFrame:
        cand = side.groupBy(*keys).agg(F.collect_list(F.struct("id", "published_at")).alias("near"))
        return (
            articles.select("id", *keys).join(cand, keys)
            .select("id", F.lit(tier).alias("tier"), F.explode("near").alias("near"))
            .select("id", "tier", F.col("near.id").alias("related_id"), F.col("near.published_at").alias("at"))
            .filter(F.col("id") != F.col("related_id"))
        )

    both = offered(mates, [cluster], 0).unionByName(offered(fill, ["category", "language"], 1))
    best = both.groupBy("id", "related_id").agg(F.min("tier").alias("tier"), F.first("at").alias("at"))
    return top_per_key(best, ["id"], [F.asc("tier"), F.desc_nulls_last("at"), F.asc("related_id")], n)


def usage_before_delete(dim: DataFrame, key: str, **uses: DataFrame) -> DataFrame:
    """Referencing rows per table and whether the row may be deleted or only archived."""
    out = dim
    for name, df in uses.items():
        counts = df.groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = sum((F.col(name) for name in uses), F.lit(0))
    return out.withColumn("action", F.when(total > 0, "archive").otherwise("delete"))


def category_lookup(categories: DataFrame, names: Sequence[str]) -> DataFrame:
    """Upper-cased id and translated names, each mapped to the category id; the lowest id wins a clash."""
    keys = F.explode(F.array(F.col("id").cast("string"), *[F.col(n) for n in names]))
    flat = categories.select(keys.alias("lookup"), "id").withColumn("lookup", F.upper(F.trim("lookup")))
    return flat.filter(F.col("lookup") != "").groupBy("lookup").agg(F.min("id").alias("category_id"))


# Names that stand for the same category.
CATEGORY_ALIASES = {
    "sports": "sports|رياضة|كرة القدم|كرة السلة|تنس|sport|football|motorsport",
    "politics": "politics|سياسة|politic",
    "business": "business|اقتصاد|أعمال|أسواق ومال|عقارات|economy|finance|markets|real_estate",
    "technology": "technology|تكنولوجيا|تقنية|علوم وتكنولوجيا|tech|ai|cybersecurity",
    "health": "health|صحة|طب وصحة|علوم وطب|medical|medicine",
    "entertainment": "entertainment|ترفيه|فن|فن وترفيه|سينما|موسيقى|cinema|music",
    "culture": "culture|ثقافة|كتب وأدب|books",
    "science": "science|علوم|علم|فضاء|space",
    "world": "world|international|أخبار دولية|دولي|العالم|regional|أخبار إقليمية",
    "general": "general|general_news|أخبار عامة|عام",
    "local": "local|أخبار محلية|محلي",
}


def alias_groups(category: Column) -> Column:
    """Groups whose aliases contain, or are contained in, the category name."""
    name = F.lower(F.trim(category))
    hits = [
        F.when(
            F.exists(
                F.array(*[F.lit(a) for a in aliases.split("|")]), lambda x: name.contains(x) | x.contains(name)
            ),
            F.lit(group),
        )
        for group, aliases in CATEGORY_ALIASES.items()
    ]
    return F.filter(F.array(*hits), lambda g: g.isNotNull())


def category_match(a: Column, b: Column) -> Column:
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | F.arrays_overlap(alias_groups(a), alias_groups(b))


def category_news_counts(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles per category by alias match.

    Articles collapse to one row per category name first; each name and its
    groups then meet the categories through equi-joined keys.
    """
    per_name = articles.groupBy("category").agg(F.count("*").alias("n"))

    def keyed(df: DataFrame, col: str, label: str) -> DataFrame:
        own = F.concat(F.lit("="), F.lower(F.trim(F.col(col))))
        groups = F.transform(alias_groups(F.col(col)), lambda g: F.concat(F.lit("@"), g))
        return df.select(F.col(label), F.explode(F.array_union(F.array(own), groups)).alias("key"))

    targets = keyed(categories, "id", "id").unionByName(keyed(categories, "name", "id")).distinct()
    pairs = keyed(per_name, "category", "category").join(targets, "key").select("id", "category").distinct()
    counts = pairs.join(per_name, "category").groupBy("id").agg(F.sum("n").alias("news_count"))
    return categories.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("news_count", F.lit(0)).alias("news_count")
    )


def localized_label(language: str, columns: Sequence[str], alias: str = "") -> Column:
    """Label in a language: its own column if filled, else the JSON translations, else empty."""
    prefix = f"{alias}." if alias else ""
    column = {"ar": "name", "en": "name_en", "fr": "name_fr", "tr": "name_tr"}.get(language, "name")
    options = []
    if column in columns:
        options.append(F.nullif(F.col(prefix + column), F.lit("")))
    if "name_translation" in columns:
        options.append(F.get_json_object(F.col(prefix + "name_translation"), f"$.{language}"))
    return F.coalesce(*options, F.lit(""))


def geo_filter(
    articles: DataFrame, start: datetime, end: datetime, language: str | None = None, category: str | None = None,
    n: int = 200,
) -> DataFrame:
    kind = articles.schema["published_at"].dataType
    df = articles.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & F.col("published_at").between(F.lit(start).cast(kind), F.lit(end).cast(kind))
    )
    if language:
        df = df.filter(F.col("language") == language)
    if category:
        df = df.filter(F.col("category") == category)
    return df.orderBy(F.desc("published_at"), "id").limit(n)


def merge_by_priority(key: str, *frames: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Union where the first frame that has a key wins."""
    tagged = [f.withColumn("__tier", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return top_per_key(out, [key], [F.asc("__tier"), *order], 1).drop("__tier")


# --- crawl planning ---------------------------------------------------------------

# Queue bounds.
MAX_ATTEMPTS = 3


def candidate_order() -> list[Column]:
    return [F.asc("freshness_order"), F.desc("source_priority"), F.asc("discovered_at"), F.asc("url_lower")]


def next_candidates(candidates: DataFrame, as_of: datetime, n: int) -> DataFrame:
    """Queue order over distinct URLs (first discovered kept), only entries that may be fetched now."""
    df = candidates.withColumn("url_lower", F.lower(F.trim("url")))
    df = top_per_key(df, ["url_lower"], [F.asc("discovered_at"), F.asc("url")], 1)
    at = F.lit(as_of).cast(candidates.schema["retry_after"].dataType)
    ready = (
        (F.col("status") == "pending") & (F.col("retry_after").isNull() | (F.col("retry_after") <= at))
        & (F.col("attempts") < MAX_ATTEMPTS)
    )
    return df.filter(ready).orderBy(*candidate_order()).limit(n)


def per_source_candidates(candidates: DataFrame, source: str, cap: int) -> DataFrame:
    """Fresh-first crawl list with at most ``cap`` URLs of each source."""
    df = candidates.withColumn("url_lower", F.lower(F.trim("url")))
    return top_per_key(df, [source], candidate_order(), cap)


def due_sources(schedules: DataFrame, as_of: datetime) -> DataFrame:
    """Enabled sources past their back-off, most important and most overdue first."""
    kind = schedules.schema["next_retry"].dataType
    at = F.lit(as_of).cast(kind)
    base = F.coalesce("next_retry", "last_successful_check")
    delay = F.pow(F.lit(2), F.least(F.greatest(F.col("consecutive_failures"), F.lit(0)), F.lit(6))).cast("int")
    check = F.coalesce(base + F.make_dt_interval(mins=F.col("refresh_interval_min") + delay), at)
    df = schedules.withColumn("next_check", check)
    due = F.col("enabled") & F.coalesce(F.col("next_retry") <= at, F.lit(True)) & (F.col("next_check") < at)
    return df.filter(due).orderBy(F.desc("priority"), "next_check", "source_url")


def crawl_interval(rank: Column, shortest: int, longest: int) -> Column:
    r = F.least(F.greatest(rank, F.lit(1)), F.lit(10))
    # integer arithmetic keeps the cut exact
    return F.floor((F.lit(longest * 10) - (longest - shortest) * (11 - r)) / 10).cast("bigint")
