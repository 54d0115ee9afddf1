"""Feed, join, ranking and set queries over the news mart."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import dates, url
from tidewire.operators import feed as fd
from tidewire.operators.keyed import single_row, top_per_key
from tidewire.plans.views import (
    ART, AS_OF, EV, NEWS, NOW, article_events, articles, category_dim, line_views, order_news, reader_events,
    source_dim, sql_bridge, sql_stamp, stamp,
)
from tidewire.registry import query
from tidewire.sources.mart import conform

CUT30 = "TIMESTAMP '2023-12-31 00:00:00'"
CUT3M = "TIMESTAMP '2023-10-30 00:00:00'"


@query("feed_published_search", f"""WITH {ART}
SELECT id, title, url FROM art WHERE status = 'published' AND category = 'economy' AND language = 'en'
  AND (contains(lower(title), 'the') OR contains(lower(summary), 'the'))""")
def _(t):
    q = fd.FeedQuery(category="economy", language="en", search="The")
    return fd.feed_filter(articles(t), q).select("id", "title", "url")


@query("feed_related_news", f"""WITH {ART}
SELECT id, url FROM art WHERE status = 'published' AND category = 'politics' AND language = 'en'
  AND (url IS NULL OR url <> (SELECT min(url) FROM art WHERE id = 9))""")
def _(t):
    art = articles(t)
    q = fd.FeedQuery(category="politics", language="en", related=True)
    shown = art.filter("id = 9").select(F.col("url").alias("shown"))
    return fd.feed_filter(art, q).join(shown, F.col("url") == F.col("shown"), "left_anti").select("id", "url")


@query("category_page_filter", f"""WITH {ART}
SELECT id, title FROM art WHERE status = 'published' AND language = 'fr' AND (contains(lower(title), 'le') OR contains(lower(summary), 'le'))""")
def _(t):
    return fd.feed_filter(articles(t), fd.FeedQuery(language="fr", search="LE")).select("id", "title")


def _suppliers(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("url"),
        F.when(F.col("s_acctbal") > 0, "published").otherwise("archived").alias("status"),
        F.concat(F.lit("N"), F.col("s_nationkey") % 5).alias("country"), F.lit("en").alias("language"),
        F.when(F.col("s_suppkey") % 4 != 0,
               F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("s_suppkey") % 72).cast("int")))
        .alias("last_crawled"), F.col("s_acctbal").alias("score"),
    )


_SRC = f"""src AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'published' ELSE 'archived' END
  AS status, 'N' || (s_nationkey % 5) AS country, s_acctbal AS score,
  CASE WHEN s_suppkey % 4 <> 0 THEN {NOW} - to_hours(CAST(s_suppkey % 72 AS INT)) END AS last_crawled FROM supplier)"""


@query("source_filter", f"""WITH {_SRC}
SELECT id, name FROM src WHERE status = 'published' AND contains(lower(name), 'supplier')
  AND (last_crawled IS NULL OR last_crawled < {NOW} - INTERVAL 24 HOUR)""")
def _(t):
    day_ago = datetime(2024, 1, 29, 12)
    return fd.source_filter(_suppliers(t), search="supplier", not_crawled_since=day_ago).select("id", "name")


@query("source_ordering", f"""WITH {_SRC} SELECT id, name, score FROM src ORDER BY score DESC, name, id LIMIT 50""")
def _(t):
    return _suppliers(t).orderBy(F.desc("score"), "name", "id").limit(50).select("id", "name", "score")


@query("category_ordering", """SELECT n_name AS name, CAST(n_regionkey AS INT) AS sort_order FROM nation
ORDER BY n_regionkey, n_name LIMIT 10""")
def _(t):
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("sort_order")).orderBy(
        "sort_order", "name").limit(10)


@query("policy_filter", f"""WITH {ART}
SELECT id FROM art WHERE trim(source_name) <> '' AND language = 'en'
  AND (published_at IS NULL OR (published_at <= {NOW} AND published_at > {CUT3M}))""")
def _(t):
    art = articles(t).withColumn("author", F.lit(None).cast("string"))
    return fd.policy_filter(art, "en", AS_OF).select("id")


@query("fresh_feed", f"""WITH {ART}
SELECT id FROM art WHERE published_at IS NULL OR published_at > {NOW} OR published_at >
  CASE WHEN event_type = 'breaking' OR category = 'breaking' THEN {CUT30} ELSE {CUT3M} END""")
def _(t):
    return fd.fresh_feed(articles(t), AS_OF).select("id")


def _fresh(col="published_at"):
    age = f"date_diff('second', {col}, {NOW})"
    return (f"CASE WHEN {col} IS NULL THEN 6 WHEN {age} <= 3600 THEN 0 WHEN {age} <= 21600 THEN 1 "
            f"WHEN {age} <= 86400 THEN 2 WHEN {age} <= 172800 THEN 3 WHEN {age} <= 259200 THEN 4 ELSE 5 END")


@query("at_least_recent", f"WITH {ART} SELECT id FROM art WHERE {_fresh()} <= 2 OR published_at IS NULL")
def _(t):
    return fd.at_least_fresh(articles(t), AS_OF, "recent", include_unknown=True).select("id")


@query("freshness_classes", f"""WITH e AS (SELECT ts AS published_at FROM events), c AS (SELECT
  ['very_fresh', 'fresh', 'recent', 'older', 'backfill', 'archive', 'unknown_date'][1 + {_fresh()}] AS freshness FROM e)
SELECT freshness, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    return t.events.groupBy(dates.freshness_class(F.col("ts"), AS_OF).alias("freshness")).agg(F.count("*").alias("n"))


@query("newest_first_unknown_last", f"""WITH {ART}
SELECT id, {sql_stamp('published_at')} AS published_at FROM art ORDER BY art.published_at DESC NULLS LAST, id LIMIT 100""")
def _(t):
    return articles(t).orderBy(F.desc_nulls_last("published_at"), "id").limit(100).select(
        "id", stamp("published_at").alias("published_at"))


@query("fresher_order_top", f"""WITH {ART}
SELECT id FROM art ORDER BY {_fresh()}, published_at DESC NULLS LAST, id LIMIT 60""")
def _(t):
    return articles(t).orderBy(*fd.fresher_order(AS_OF)).limit(60).select("id")


@query("within_days_and_months", f"""SELECT
  count(*) FILTER (ts <= {NOW} AND ts > TIMESTAMP '2024-01-23 00:00:00') AS within_7_days,
  count(*) FILTER (ts <= {NOW} AND ts > {CUT3M}) AS within_3_months FROM events""")
def _(t):
    ts = F.col("ts")
    return t.events.agg(F.count_if(dates.within(ts, AS_OF, days=7)).alias("within_7_days"),
                        F.count_if(dates.within(ts, AS_OF, months=3)).alias("within_3_months"))


@query("user_date_span_labels", """WITH s AS (SELECT user_id, date_diff('second', min(ts), max(ts)) // 86400 AS d
  FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, CASE WHEN d < 1 THEN 'today' WHEN d < 7 THEN d || ' days'
  WHEN d < 30 THEN CAST(ceil(d / 7.0) AS BIGINT) || ' weeks' ELSE CAST(ceil(d / 30.0) AS BIGINT) || ' months' END
  AS span FROM s""")
def _(t):
    ev = t.events.filter("event_type = 'view'")
    return ev.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "user_id", dates.span_label(F.col("a"), F.col("b")).alias("span"))


@query("user_list_search", """SELECT c_custkey AS id, c_name AS display_name FROM customer
WHERE contains(lower(c_name), '00012') AND c_mktsegment = 'BUILDING'""")
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"),
                              F.lit("").alias("email"), F.col("c_mktsegment").alias("role"))
    return fd.user_list(users, "00012", "BUILDING").select("id", "display_name")


# --- joins ------------------------------------------------------------------------


@query("news_with_category_and_source", f"""WITH {NEWS}
SELECT id, category_id, n_name AS category_name, coalesce(s_name, CAST(source_id AS VARCHAR)) AS source_name
FROM news LEFT JOIN nation ON category_id = n_nationkey LEFT JOIN supplier ON source_id = s_suppkey""")
def _(t):
    return fd.with_dimensions(order_news(t), category_dim(t), source_dim(t)).select(
        "id", "category_id", "category_name", "source_name")


@query("views_per_article", f"""WITH {NEWS}, v AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
SELECT id, coalesce(c, 0) AS views_count FROM news LEFT JOIN v ON id = l_orderkey""")
def _(t):
    return fd.view_counts(order_news(t).select("id"), line_views(t))


_PAGE = """SELECT p.id, title, n_name AS category_name, coalesce(c, 0) AS views_count FROM p
LEFT JOIN nation ON category_id = n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) v ON p.id = l_orderkey"""


@query("feed_page_by_date", f"""WITH {NEWS}, p AS (SELECT * FROM news WHERE status = 'published' AND language = 'en'
  ORDER BY published_at DESC, id LIMIT 20 OFFSET 40) {_PAGE}""")
def _(t):
    q = fd.FeedQuery(language="en", page=3)
    return fd.feed(order_news(t), q, category_dim(t), source_dim(t), line_views(t)).select(
        "id", "title", "category_name", "views_count")


@query("feed_page_by_views", f"""WITH {NEWS}, p AS (SELECT news.* FROM news
  LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) v ON id = l_orderkey
  WHERE status = 'published' ORDER BY coalesce(c, 0) DESC, published_at DESC, id LIMIT 50) {_PAGE}""")
def _(t):
    q = fd.FeedQuery(sort="views", limit=50)
    return fd.feed(order_news(t), q, category_dim(t), source_dim(t), line_views(t)).select(
        "id", "title", "category_name", "views_count")


@query("feed_page_info", f"""WITH {NEWS} SELECT CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
  count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM news WHERE status = 'published'""")
def _(t):
    return fd.page_info(fd.feed_filter(order_news(t), fd.FeedQuery()), 3, 20)


@query("feed_keyset_page", f"""WITH {NEWS} SELECT id, title FROM news WHERE published_at < TIMESTAMP '1997-06-01'
  OR (published_at = TIMESTAMP '1997-06-01' AND id > 500) ORDER BY published_at DESC, id LIMIT 100""")
def _(t):
    return fd.page_after(order_news(t), datetime(1997, 6, 1), 500, 100).select("id", "title")


@query("feed_sorted_by_title", f"""WITH {NEWS} SELECT id, title FROM news WHERE status = 'published'
  ORDER BY title, published_at DESC, id LIMIT 100""")
def _(t):
    df = fd.feed_filter(order_news(t), fd.FeedQuery())
    return fd.page_of(df, fd.sort_columns("title", False), 1, 500).select("id", "title")


@query("saved_articles", f"""WITH {EV}, {ART}, b AS (SELECT * FROM {sql_bridge('purchase')})
SELECT action_id, user_id, article_id, title FROM b JOIN art ON b.article_id = art.id WHERE status = 'published'
ORDER BY created_at DESC, action_id LIMIT 100""")
def _(t):
    saved = fd.bridged_articles(article_events(t, "purchase"), articles(t), published_only=True)
    return saved.orderBy(F.desc("created_at"), "action_id").limit(100).select(
        "action_id", "user_id", "article_id", "title")


@query("reading_history", f"""WITH {EV}, {ART}, b AS (SELECT user_id, article_id, max(created_at) AS read_at
  FROM {sql_bridge('click')} GROUP BY 1, 2)
SELECT user_id, article_id, title, {sql_stamp('read_at')} AS read_at FROM b JOIN art ON b.article_id = art.id""")
def _(t):
    reads = article_events(t, "click").groupBy("user_id", "article_id").agg(F.max("created_at").alias("read_at"))
    return fd.bridged_articles(reads, articles(t)).select(
        "user_id", "article_id", "title", stamp("read_at").alias("read_at"))


@query("comments_with_article_titles", f"""WITH {ART}
SELECT conv_id, turn, role AS user_name, title AS article_title FROM conversations LEFT JOIN art ON conv_id = id
WHERE contains(lower(conversations.text), 'the') OR contains(lower(role), 'the')""")
def _(t):
    comments = t.conversations.withColumnsRenamed({"role": "user_name"}).withColumn("article_id", F.col("conv_id"))
    return fd.comments_with_titles(comments, articles(t), "The").select(
        "conv_id", "turn", "user_name", "article_title")


@query("reports_with_article_titles", f"""WITH {EV}, {ART}
SELECT r.id, title AS article_title, language AS article_language FROM evn r
LEFT JOIN art ON CAST(r.article_id AS BIGINT) = art.id WHERE r.event_type = 'error'
  AND (contains(r.article_id, '7') OR contains(lower(title), '7') OR contains(r.device_os, '7')
       OR contains(lower(r.country_code), '7'))""")
def _(t):
    reports = reader_events(t).filter("event_type = 'error'").filter(F.col("created_at") <= dates.now(AS_OF))
    reports = reports.drop("article_title").withColumnsRenamed({"device_os": "reported_by_name", "country_code": "reason"})
    news = articles(t).withColumn("id", F.col("id").cast("string"))
    return fd.reports_with_titles(reports, news, "7").select("id", "article_title", "article_language")


@query("resolve_article_refs", """WITH r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url
  ELSE CAST(page_id * 2 AS VARCHAR) END AS ref FROM pages)
SELECT r.page_id, coalesce(a.page_id, b.page_id) AS article_id FROM r
LEFT JOIN pages a ON r.ref = CAST(a.page_id AS VARCHAR)
LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1) b ON r.ref = b.url""")
def _(t):
    refs = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        (F.col("page_id") * 2).cast("string")).alias("ref"))
    news = t.pages.select(F.col("page_id").alias("id"), "url")
    return fd.resolve_refs(refs, news).select("page_id", "article_id")


@query("unknown_urls", """WITH u AS (SELECT page_id, lower(trim(url)) AS k FROM pages)
SELECT page_id FROM u WHERE k NOT IN (SELECT k FROM u WHERE page_id % 3 = 0)
  AND k NOT IN (SELECT k FROM u WHERE page_id % 5 = 0)""")
def _(t):
    u = t.pages.select("page_id", F.lower(F.trim("url")).alias("url_key"))
    return fd.unknown_urls(u, u.filter("page_id % 3 = 0"), u.filter("page_id % 5 = 0")).select("page_id")


@query("due_for_recrawl", f"""WITH {EV}, u AS (SELECT DISTINCT install FROM ev),
l AS (SELECT install, max(created_at) AS c FROM evn WHERE event_type = 'view' AND created_at >= {NOW} - INTERVAL 20 DAY
  GROUP BY 1)
SELECT u.install, {sql_stamp('c')} AS last_crawl FROM u LEFT JOIN l USING (install)
WHERE c IS NULL OR c < {NOW} - INTERVAL 1 HOUR""")
def _(t):
    ev = reader_events(t)
    crawls = ev.filter((F.col("event_type") == "view") & F.col("created_at").between(
        F.lit(datetime(2024, 1, 10, 12)).cast("timestamp_ntz"), dates.now(AS_OF)))
    due = fd.due_for_recrawl(ev.select("install").distinct(), crawls, AS_OF, "install", "created_at")
    return due.select("install", stamp("last_crawl").alias("last_crawl"))


@query("bookmarks_with_article", f"""WITH {EV}, {ART}
SELECT action_id FROM {sql_bridge('purchase')} b WHERE EXISTS (SELECT 1 FROM art WHERE id = b.article_id AND status = 'published')""")
def _(t):
    alive = articles(t).filter("status = 'published'").select(F.col("id").alias("article_id"))
    return article_events(t, "purchase").join(alive, "article_id", "left_semi").select("action_id")


@query("related_articles", f"""WITH {ART}, c AS (
  SELECT a.id, b.id AS related_id, CASE WHEN a."cluster" = b."cluster" THEN 0 ELSE 1 END AS tier, b.published_at AS pub
  FROM art a JOIN art b ON a.id <> b.id AND (a."cluster" = b."cluster" OR (a.category = b.category AND a.language = b.language)))
SELECT id, related_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, pub DESC NULLS LAST, related_id) AS r
  FROM c) WHERE r <= 6""")
def _(t):
    art = articles(t).select("id", "cluster", "category", "language", "published_at")
    return fd.related_articles(art, "cluster", 6).select("id", "related_id")


@query("usage_before_delete", f"""WITH {NEWS}, n AS (SELECT category_id, count(*) AS c FROM news WHERE price > 300000 GROUP BY 1),
s AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1)
SELECT n_nationkey AS category_id, coalesce(n.c, 0) AS news_count, coalesce(s.c, 0) AS source_count,
  CASE WHEN coalesce(n.c, 0) + coalesce(s.c, 0) > 0 THEN 'archive' ELSE 'delete' END AS action
FROM nation LEFT JOIN n ON n_nationkey = category_id LEFT JOIN s ON n_nationkey = s_nationkey""")
def _(t):
    return fd.usage_before_delete(
        category_dim(t).select("category_id"), "category_id",
        news_count=order_news(t).filter("price > 300000"),
        source_count=t.supplier.select(F.col("s_nationkey").alias("category_id")))


@query("category_lookup", """WITH k AS (SELECT upper(trim(CAST(p_partkey AS VARCHAR))) AS lookup, p_partkey AS id FROM part
  UNION ALL SELECT upper(trim(p_name)), p_partkey FROM part UNION ALL SELECT upper(trim(p_brand)), p_partkey FROM part)
SELECT lookup, CAST(min(id) AS VARCHAR) AS category_id FROM k WHERE lookup <> '' GROUP BY 1""")
def _(t):
    cats = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("name_en"))
    return fd.category_lookup(cats, ["name", "name_en"]).select(
        "lookup", F.col("category_id").cast("string").alias("category_id"))


@query("category_news_counts", f"""WITH {ART}, c AS (SELECT category, count(*) AS n FROM art GROUP BY 1)
SELECT id, CAST(coalesce(sum(n) FILTER (m), 0) AS BIGINT) AS news_count FROM
 (SELECT t.id, n, category = t.id OR (category, t.id) IN (('economy', 'business'), ('sports', 'sports'), ('technology', 'tech'),
   ('culture', 'books')) AS m FROM c, (VALUES ('business'), ('sports'), ('tech'), ('books'), ('space')) t(id)) GROUP BY id""")
def _(t):
    art = articles(t)
    ids = ("business", "sports", "tech", "books", "space")
    one = art.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))
    return fd.category_news_counts(art, one.withColumn("name", F.col("id")))


@query("localized_labels", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'tr-' || n_nationkey END
  AS label FROM nation""")
def _(t):
    cats = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise("").alias("name_en"),
        F.to_json(F.struct(F.concat(F.lit("tr-"), "n_nationkey").alias("en"))).alias("name_translation"))
    return cats.select("id", fd.localized_label("en", cats.columns).alias("label"))


@query("geo_filter_newest", f"""WITH {ART} SELECT id FROM art WHERE id % 3 <> 0 AND language = 'en'
  AND published_at BETWEEN TIMESTAMP '2023-11-01' AND {NOW} ORDER BY published_at DESC, id LIMIT 200""")
def _(t):
    art = articles(t)
    for c, k in (("latitude", 90), ("longitude", 180)):
        art = art.withColumn(c, F.when(F.col("id") % 3 != 0, (F.col("id") % k).cast("double")))
    return fd.geo_filter(art, datetime(2023, 11, 1), AS_OF, language="en").select("id")


@query("conform_missing_columns", """SELECT doc_id AS id, text AS title, 'general' AS category, CAST(NULL AS VARCHAR) AS image_url,
  CAST(coalesce(n_chars, 0) AS INT) AS read_count, source AS source_name FROM documents""")
def _(t):
    raw = t.documents.withColumnsRenamed({"doc_id": "id", "text": "title", "n_chars": "read_count",
                                          "source": "source_name"})
    return conform(raw, "id bigint, title string, category string, image_url string, read_count int, source_name string",
                   {"category": "general", "read_count": 0})


# --- ranking ----------------------------------------------------------------------


@query("top_read_articles", f"""WITH {EV}, {ART}, c AS (SELECT article_id, count(*) AS n FROM {sql_bridge('click')} GROUP BY 1)
SELECT id, n AS reads FROM art JOIN c ON id = article_id WHERE language = 'en'
ORDER BY n DESC, published_at DESC NULLS LAST, id DESC LIMIT 20""")
def _(t):
    counts = article_events(t, "click").groupBy("article_id").agg(F.count("*").alias("reads"))
    top = articles(t).filter("language = 'en'").join(counts, F.col("id") == F.col("article_id"))
    return top.orderBy(F.desc("reads"), F.desc_nulls_last("published_at"), F.desc("id")).limit(20).select("id", "reads")


def _candidates(t):
    p = t.pages.filter(F.col("page_id").isNotNull())
    discovered = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(mins=(F.col("page_id") * 13 % 500).cast("int"))
    published = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("page_id") * 7 % 100).cast("int"))
    retry = F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("page_id") % 60 - 30).cast("int"))
    return p.select(
        "page_id", F.regexp_extract("url", r"^[^?#]*", 0).alias("url"), url.host(F.col("url")).alias("source_id"),
        F.when(F.col("page_id") % 4 == 0, "failed").otherwise("pending").alias("status"),
        (F.col("page_id") % 5).alias("attempts"), (F.col("page_id") % 10).alias("source_priority"),
        dates.freshness_order(published, AS_OF).alias("freshness_order"), discovered.alias("discovered_at"),
        F.when(F.col("page_id") % 3 == 0, retry).alias("retry_after"))


_CAND = f"""cand AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS url,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS source_id,
  CASE WHEN page_id % 4 = 0 THEN 'failed' ELSE 'pending' END AS status, page_id % 5 AS attempts, page_id % 10 AS pr,
  {_fresh(f"({NOW} - to_hours(CAST(page_id * 7 % 100 AS INT)))")} AS f, {NOW} - to_minutes(CAST(page_id * 13 % 500 AS INT)) AS d,
  CASE WHEN page_id % 3 = 0 THEN {NOW} + to_minutes(CAST(page_id % 60 - 30 AS INT)) END AS retry FROM pages)"""


@query("next_crawl_candidates", f"""WITH {_CAND}, u AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY d, url) AS r FROM cand)
SELECT page_id, source_id FROM u WHERE r = 1 AND status = 'pending' AND (retry IS NULL OR retry <= {NOW}) AND attempts < 3
ORDER BY f, pr DESC, d, lower(url) LIMIT 50""")
def _(t):
    return fd.next_candidates(_candidates(t), AS_OF, 50).select("page_id", "source_id")


@query("crawl_caps_per_source", f"""WITH {_CAND}, u AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY f, pr DESC, d, lower(trim(url))) AS r FROM cand)
SELECT page_id, source_id FROM u WHERE r <= 2""")
def _(t):
    return fd.per_source_candidates(_candidates(t), "source_id", 2).select("page_id", "source_id")


@query("due_sources", f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 10 AS priority, 30 + s_suppkey % 60 AS every,
  s_suppkey % 9 AS fails, CASE WHEN s_suppkey % 3 = 0 THEN {NOW} - to_minutes(CAST(s_suppkey * 7 % 300 - 100 AS INT)) END AS retry,
  CASE WHEN s_suppkey % 2 = 0 THEN {NOW} - to_minutes(CAST(s_suppkey * 11 % 400 AS INT)) END AS ok FROM supplier WHERE s_acctbal > 0),
n AS (SELECT *, coalesce(coalesce(retry, ok) + to_minutes(CAST(every + pow(2, least(fails, 6)) AS INT)), {NOW}) AS nxt FROM s)
SELECT id, {sql_stamp('nxt')} AS next_check FROM n WHERE (retry IS NULL OR retry <= {NOW}) AND nxt < {NOW}""")
def _(t):
    k, at = F.col("s_suppkey"), F.lit(AS_OF).cast("timestamp_ntz")
    s = t.supplier.select(
        k.alias("source_url"), (F.col("s_acctbal") > 0).alias("enabled"), (k % 10).alias("priority"),
        (30 + k % 60).cast("int").alias("refresh_interval_min"), (k % 9).alias("consecutive_failures"),
        F.when(k % 3 == 0, at - F.make_dt_interval(mins=(k * 7 % 300 - 100).cast("int"))).alias("next_retry"),
        F.when(k % 2 == 0, at - F.make_dt_interval(mins=(k * 11 % 400).cast("int"))).alias("last_successful_check"))
    return fd.due_sources(s, AS_OF).select(F.col("source_url").alias("id"), stamp("next_check").alias("next_check"))


@query("crawl_intervals", """SELECT s_suppkey AS id,
  CAST(floor((6000 - 550 * (11 - least(greatest(s_suppkey % 14, 1), 10))) / 10.0) AS BIGINT) AS minutes FROM supplier""")
def _(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"),
                             fd.crawl_interval(F.col("s_suppkey") % 14, 50, 600).alias("minutes"))


# --- sets and totals --------------------------------------------------------------


@query("merge_lists_first_wins", f"""WITH {ART}, u AS (SELECT url, id, 0 AS tier FROM art WHERE language = 'en'
  UNION ALL SELECT url, id, 1 FROM art WHERE status = 'draft' UNION ALL SELECT url, id, 2 FROM art)
SELECT url, id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tier, id) AS r FROM u) WHERE r = 1""")
def _(t):
    art = articles(t).select("url", "id", "language", "status")
    return fd.merge_by_priority("url", art.filter("language = 'en'"), art.filter("status = 'draft'"), art,
                                order=[F.asc("id")]).select("url", "id")


@query("new_minus_existing", """SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0
EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0""")
def _(t):
    fetched, known = t.pages.filter("page_id % 2 = 0"), t.pages.filter("page_id % 3 = 0")
    return fd.unknown_urls(fetched.select("url").distinct(), known, key="url")


@query("distinct_sources_first_wins", """SELECT name, id FROM (SELECT lower(trim(p_name)) AS name, p_partkey AS id,
  row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1""")
def _(t):
    parts = t.part.select(F.lower(F.trim("p_name")).alias("name"), F.col("p_partkey").alias("id"))
    return top_per_key(parts, ["name"], [F.asc("id")], 1)


@query("content_totals", """SELECT (SELECT count(*) FROM orders) AS total_news,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O') AS published_news, (SELECT count(*) FROM nation) AS categories,
  (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM conversations) AS comments,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS likes,
  (SELECT count(*) FROM events WHERE event_type = 'click') AS saves""")
def _(t):
    n = F.count("*")
    return single_row(
        t.orders.agg(n.alias("total_news"), F.count_if(F.col("o_orderstatus") != "O").alias("published_news")),
        t.nation.agg(n.alias("categories")), t.customer.agg(n.alias("users")),
        t.conversations.agg(n.alias("comments")),
        t.events.agg(F.count_if(F.col("event_type") == "purchase").alias("likes"),
                     F.count_if(F.col("event_type") == "click").alias("saves")))


@query("news_by_category_top8", f"""WITH {ART} SELECT category, count(*) AS n FROM art GROUP BY 1
ORDER BY n DESC, category LIMIT 8""")
def _(t):
    return articles(t).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(8)


@query("activity_feed_newest", f"""WITH {EV}, {ART}, a AS (
(SELECT 'behavior' AS kind, id, event_type || ': ' || article_title AS title, created_at AS made_at FROM evn ORDER BY id DESC LIMIT 12)
UNION ALL (SELECT 'news', id, 'news: ' || substr(title, 1, 60), published_at FROM art WHERE published_at <= {NOW}
  ORDER BY published_at DESC, id LIMIT 5)
UNION ALL (SELECT 'order', o_orderkey, 'order: ' || o_orderpriority, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5))
SELECT kind, id, title, {sql_stamp('made_at')} AS happened_at FROM a ORDER BY made_at DESC, kind, id LIMIT 15""")
def _(t):
    at = F.col("at")
    ev = reader_events(t).filter(F.col("created_at") <= dates.now(AS_OF)).orderBy(F.desc("id")).limit(12).select(
        F.lit("behavior").alias("kind"), "id", F.concat("event_type", F.lit(": "), "article_title").alias("title"),
        F.col("created_at").alias("at"))
    news = articles(t).filter(F.col("published_at") <= dates.now(AS_OF)).orderBy(
        F.desc("published_at"), "id").limit(5).select(
        F.lit("news").alias("kind"), "id", F.concat(F.lit("news: "), F.substring("title", 1, 60)).alias("title"),
        F.col("published_at").alias("at"))
    orders = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order: "), "o_orderpriority").alias("title"), F.col("o_orderdate").alias("at"))
    merged = ev.unionByName(news).unionByName(orders).orderBy(F.desc("at"), "kind", "id").limit(15)
    return merged.select("kind", "id", "title", stamp(at).alias("happened_at"))


@query("article_counts_per_source", f"""WITH {ART}
SELECT source_name, language, count(*) AS n, {sql_stamp('max(published_at)')} AS last_crawl FROM art GROUP BY 1, 2""")
def _(t):
    return articles(t).groupBy("source_name", "language").agg(
        F.count("*").alias("n"), stamp(F.max("published_at")).alias("last_crawl"))


@query("corpus_stats", f"""WITH {ART}
SELECT count(*) AS articles, count(DISTINCT source_name) AS active_sources, {sql_stamp('max(published_at)')} AS last_update
FROM art WHERE published_at <= {NOW}""")
def _(t):
    return articles(t).filter(F.col("published_at") <= dates.now(AS_OF)).agg(
        F.count("*").alias("articles"), F.count_distinct("source_name").alias("active_sources"),
        stamp(F.max("published_at")).alias("last_update"))


@query("source_yield", f"""WITH {ART}
SELECT source_name, CAST(count(*) FILTER (status = 'published') AS DOUBLE) / greatest(count(*), 1) AS yield FROM art GROUP BY 1""")
def _(t):
    return articles(t).groupBy("source_name").agg(
        (F.count_if(F.col("status") == "published") / F.greatest(F.count("*"), F.lit(1))).alias("yield"))


@query("event_page_stats", f"""WITH {ART}, s AS (SELECT "cluster", count(*) AS n, count(DISTINCT source_name) AS sources,
  min(published_at) AS a, max(published_at) AS b FROM art GROUP BY 1)
SELECT "cluster", n, sources, {sql_stamp('a')} AS first_at, {sql_stamp('b')} AS last_at,
  CASE WHEN d < 1 THEN 'today' WHEN d < 7 THEN d || ' days' WHEN d < 30 THEN CAST(ceil(d / 7.0) AS BIGINT) || ' weeks'
   WHEN d >= 30 THEN CAST(ceil(d / 30.0) AS BIGINT) || ' months' END AS span
FROM (SELECT *, date_diff('second', a, b) // 86400 AS d FROM s)""")
def _(t):
    # one row per (cluster, source) first, so that neither a hot cluster nor its sources gather in one task
    part = articles(t).groupBy("cluster", "source_name").agg(
        F.count("*").alias("n"), F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return part.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.count("source_name").alias("sources"), F.min("a").alias("a"), F.max("b").alias("b")
    ).select("cluster", "n", "sources", stamp("a").alias("first_at"), stamp("b").alias("last_at"),
             F.when(F.col("a").isNotNull(), dates.span_label(F.col("a"), F.col("b"))).alias("span"))
