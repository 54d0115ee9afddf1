"""Sources, merges, ingestion and streams. Feed documents are made by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.functions import text as tx
from tidewire.functions import url as ux
from tidewire.operators import flow, geo
from tidewire.plans import sqltext as sq
from tidewire.plans.views import ART, AS_OF, EV, NOW, articles, reader_events, sql_stamp, stamp
from tidewire.registry import query
from tidewire.schemas import MART_SCHEMAS
from tidewire.session import scratch_path
from tidewire.sources import feeds
from tidewire.sources.keyed_table import SESSION_STATE, last_write_wins, merged, read_state, session_fold
from tidewire.streaming import ingest as ing

C = F.col


def text_stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- feeds ------------------------------------------------------------------------------


def _xml_safe(col):
    return F.regexp_replace(col, r"[^\p{L}\p{N} ]", " ")


@query("feed_articles", f"""WITH {ART} SELECT id, trim(regexp_replace(title, '[^\\pL\\pN ]', ' ', 'g')) AS title, url,
  strftime(TIMESTAMP '2024-01-01 10:30:00' + to_days(CAST(id % 28 AS INT)), '%Y-%m-%d %H:%M:%S') AS published_at FROM art
WHERE trim(regexp_replace(title, '[^\\pL\\pN ]', ' ', 'g')) <> ''""")
def _(t):
    art = articles(t)
    day = F.lpad((C("id") % 28 + 1).cast("string"), 2, "0")
    item = F.concat(F.lit("<rss><channel><item><title>"), _xml_safe("title"), F.lit("</title><link>"), C("url"),
                    F.lit("</link><description>"), _xml_safe("summary"), F.lit("</description><pubDate>Mon, "), day,
                    F.lit(" Jan 2024 12:30:00 +0200</pubDate><guid>"), C("id"), F.lit("</guid></item></channel></rss>"))
    rows = feeds.parse_feed_documents(art.select("id", item.alias("xml")), "xml", AS_OF)
    return rows.select("id", "title", "url", text_stamp("published_at").alias("published_at"))


@query("sitemap_urls", f"WITH {ART} SELECT id, url, '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') AS date_hint FROM art")
def _(t):
    day = F.lpad((C("id") % 28 + 1).cast("string"), 2, "0")
    xml = F.concat(F.lit("<urlset><url><loc>"), C("url"), F.lit("</loc><lastmod>2024-01-"), day, F.lit("</lastmod></url></urlset>"))
    return feeds.parse_sitemap_documents(articles(t).select("id", xml.alias("xml")), "xml").select("id", "url", "date_hint")


@query("article_list_feed", f"""WITH {ART} SELECT url, title, source_name, strftime(TIMESTAMP '2024-01-15 08:00:00' + to_seconds(CAST(id % 60 AS INT)), '%Y-%m-%d %H:%M:%S') AS published_at
FROM art WHERE title <> ''""")
def _(t):
    art = articles(t)
    seen = F.concat(F.lit("20240115T0800"), F.lpad((C("id") % 60).cast("string"), 2, "0"), F.lit("Z"))
    row = F.struct("url", "title", seen.alias("seendate"), F.lit("").alias("socialimage"), C("source_name").alias("domain"), "language")
    docs = art.select(F.to_json(F.struct(F.array(row).alias("articles"))).alias("body"))
    return feeds.parse_article_list(docs, "body").select("url", "title", "source_name", text_stamp("published_at").alias("published_at"))


@query("claim_reviews", """SELECT 'https://check.example.org/' || item_id AS url, 'Claim: ' || text || ' | Rating: ' ||
  CASE WHEN item_id % 2 = 0 THEN 'False' ELSE 'True' END AS summary FROM benchmark""")
def _(t):
    rating = F.when(C("item_id") % 2 == 0, "False").otherwise("True")
    review = F.struct(F.concat(F.lit("https://check.example.org/"), "item_id").alias("url"), rating.alias("textualRating"))
    claim = F.struct("text", F.array(review).alias("claimReview"))
    docs = t.benchmark.select(F.to_json(F.struct(F.array(claim).alias("claims"))).alias("body"))
    return feeds.parse_claims(docs, "body").select("url", "summary")


@query("search_hits", """SELECT 'https://wiki.example.org/' || replace(p_name, ' ', '_') AS url, p_name AS title, 'A ' || p_brand AS summary, p_partkey AS id FROM part""")
def _(t):
    hit = F.struct(C("p_name").alias("title"), C("p_partkey").alias("pageid"), F.concat(F.lit("A <b>"), "p_brand", F.lit("</b>")).alias("snippet"))
    docs = t.part.select(C("p_partkey").alias("id"), F.to_json(F.struct(F.struct(F.array(hit).alias("search")).alias("query"))).alias("body"))
    return feeds.parse_search(docs, "body", "https://wiki.example.org/").select("url", "title", "summary", "id")


@query("source_catalogue", "SELECT n_name AS country, s_name AS name, 'ar,en' AS language, CAST(s_suppkey % 10 AS INT) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    src = F.struct(C("s_name").alias("name"), F.lit("").alias("url"), F.array(F.lit("ar"), F.lit("en")).alias("language"),
                   (C("s_suppkey") % 10).cast("int").alias("rank"), F.lit("general").alias("category"), F.lit("rss").alias("type"))
    per_source = t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).select(F.array(F.struct(
        C("n_name").alias("country"), F.lit("XX").alias("country_code"), F.array(src).alias("sources"))).alias("countries"))
    return feeds.flatten_sources(per_source).select("country", "name", "language", "rank")


@query("tree_bridges", f"""WITH {EV} SELECT DISTINCT CAST(install AS VARCHAR) AS user_id, article_id FROM evn WHERE event_type = 'purchase'""")
def _(t):
    likes = reader_events(t).filter((C("event_type") == "purchase") & (C("created_at") <= dates.now(AS_OF)))
    tree = likes.select(F.to_json(F.create_map(C("install").cast("string"), F.create_map("article_id", F.lit("true")))).alias("tree"))
    return feeds.explode_bridge(tree, "tree", "user_id", "article_id", "v").select("user_id", "article_id").distinct()


@query("discovered_capped", f"""WITH {ART}, u AS (SELECT 'a' AS provider, url, id, published_at FROM art WHERE language = 'en'
  UNION ALL SELECT 'b', url, id, published_at FROM art WHERE language <> 'en')
SELECT provider, id FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY published_at DESC NULLS LAST, url, id) AS r FROM u) WHERE r <= 50""")
def _(t):
    art = articles(t).select("id", "url", "published_at", "language")
    both = feeds.discover({"a": art.filter("language = 'en'"), "b": art.filter("language <> 'en'")}, 50, ["id"])
    return both.select("provider", "id")


# --- writes -----------------------------------------------------------------------------


@query("repaired_articles", f"""WITH {ART} SELECT id, CASE WHEN id % 4 = 0 THEN 'exclusive' ELSE source_name END AS source_name,
  CASE WHEN status = 'draft' THEN 'draft' ELSE 'published' END AS status, {sql_stamp(f'coalesce(published_at, {NOW})')} AS published_at FROM art""")
def _(t):
    art = articles(t).withColumns({
        "source_name": F.when(C("id") % 4 != 0, C("source_name")).otherwise(" "), "image_url": F.lit(""),
        "status": F.when(C("status") == "draft", "draft").otherwise("odd")})
    return feeds.repaired(art, AS_OF).select("id", "source_name", "status", stamp("published_at").alias("published_at"))


@query("saved_pages", f"""SELECT page_id, {sq.host('url')} AS source_name, CASE WHEN page_id % 2 = 0 THEN 0.5 ELSE 0.85 END AS source_score FROM pages""")
def _(t):
    df = t.pages.select("page_id", "url", F.lit("t").alias("title"), F.when(C("page_id") % 2 == 0, 0.5).alias("source_score"), F.lit(None).cast("string").alias("status"))
    return feeds.saved_documents(df).select("page_id", "source_name", "source_score")


@query("source_scores", "SELECT s_suppkey AS id, CAST(least(greatest(round(s_acctbal / 5000, 2), 0), 0.99) AS DOUBLE) AS score FROM supplier")
def _(t):
    return t.supplier.select(C("s_suppkey").alias("id"), feeds.source_score(C("s_acctbal") / 5000).cast("double").alias("score"))


@query("upsert_by_url_language", f"""WITH {ART}, u AS (SELECT url, language, min(id) AS id FROM art GROUP BY 1, 2), o AS (SELECT * FROM u WHERE id % 3 <> 0), n AS (SELECT * FROM u WHERE id % 3 <> 1)
SELECT url, language, CASE WHEN o.id IS NOT NULL THEN CAST(o.id AS VARCHAR) ELSE 'article_' || sha256(url || '|' || language) END AS id,
  CASE WHEN n.id IS NOT NULL THEN 'new' ELSE 'old' END AS state, o.id IS NOT NULL AND n.id IS NOT NULL AS updated FROM o FULL JOIN n USING (url, language)""")
def _(t):
    u = articles(t).groupBy("url", "language").agg(F.min("id").alias("id"))
    old = u.filter("id % 3 <> 0").select("url", "language", C("id").cast("string").alias("id"), F.lit("old").alias("state"))
    new = u.filter("id % 3 <> 1").select("url", "language", F.lit("new").alias("state"))
    return feeds.upsert_by_url_language(old, new).select("url", "language", "id", "state", "updated")


@query("article_upserts", f"""WITH {ART} SELECT url, arg_max(id, id) AS id FROM art GROUP BY url""")
def _(t):
    art = articles(t)
    batches = [part.select("url", "id", "title") for part in (art.filter("status = 'draft'"), art, art.filter("language = 'fr'"))]
    return merged(last_write_wins(["url"], ["id"]), *batches).select("url", "id")


# --- ingestion --------------------------------------------------------------------------


def _posts(t):
    ev = reader_events(t)
    own = F.struct(
        C("event_type").alias("type"), F.lit(None).cast("string").alias("event"), (F.unix_micros(C("created_at").cast("timestamp")) / 1000).cast("bigint").alias("ts"),
        F.when(C("id") % 7 != 0, C("article_id")).otherwise("").alias("articleId"), F.lit(None).cast("string").alias("article_id"),
        C("article_title").alias("articleTitle"), F.lit(None).cast("string").alias("article_title"), "category",
        (C("duration_ms") * F.when(C("id") % 5 == 0, 100000).when(C("id") % 3 == 0, -1).otherwise(1)).alias("durationMs"), F.lit(None).cast("bigint").alias("duration_ms"), "metadata")
    posts = ev.groupBy("install", F.to_date("created_at").alias("day")).agg(F.array_sort(F.collect_list(own)).alias("events"), F.max("created_at").alias("arrived"))
    null = F.lit(None).cast("string")
    return posts.select(
        F.concat(F.lit(" s"), "install").alias("sessionId"), null.alias("session_id"), F.when(C("install") % 2 == 0, C("install").cast("string")).otherwise("").alias("userId"),
        null.alias("deviceOs"), F.lit("ios").alias("os"), null.alias("appVersion"), F.when(C("install") % 3 == 0, "xx").otherwise("fr").alias("countryCode"),
        null.alias("type"), null.alias("event"), F.lit(None).cast("bigint").alias("ts"), null.alias("articleId"), null.alias("article_id"), null.alias("articleTitle"),
        null.alias("article_title"), null.alias("category"), F.lit(None).cast("bigint").alias("durationMs"), F.lit(None).cast("bigint").alias("duration_ms"),
        null.alias("metadata"), "events", "arrived")


@query("ingested_events", f"""WITH {EV} SELECT 's' || install AS session_id, CASE WHEN install % 3 = 0 THEN 'EG' ELSE 'FR' END AS country_code, event_type,
  count(*) AS n, CAST(sum(CASE WHEN id % 5 = 0 THEN least(duration_ms * 100000, 86400000) WHEN id % 3 = 0 THEN 0 ELSE duration_ms END) AS BIGINT) AS duration,
  count(*) FILTER (id % 7 = 0) AS no_article FROM ev WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL""")
def _(t):
    clean = ing.clean_events(_posts(t), "arrived", ("view", "click", "purchase"))
    return clean.groupBy("session_id", "country_code", "event_type").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("duration"), F.count_if(C("article_id").isNull()).alias("no_article"))


def _pings(t):
    null = F.lit(None).cast("string")
    return reader_events(t).select(
        C("install").cast("string").alias("sessionId"), null.alias("deviceId"), F.when(C("id") % 4 == 0, C("install").cast("string")).alias("userId"),
        C("device_os").alias("deviceOs"), null.alias("os"), null.alias("appVersion"), F.lit("SA").alias("countryCode"), F.lit(1).alias("isNewInstall"),
        C("created_at").alias("ping_at"), C("id").alias("ping_id"))


_HEART = f"""SELECT CAST(install AS VARCHAR) AS session_id, max(CASE WHEN id % 4 = 0 THEN CAST(install AS VARCHAR) END) AS user_id, 'SA' AS country_code,
  {sql_stamp('max(created_at)')} AS last_ping, {sql_stamp('min(created_at)')} AS created_at FROM ev GROUP BY 1"""


@query("session_table", f"WITH {EV} {_HEART}")
def _(t):
    changes = ing.clean_heartbeats(_pings(t))
    noon = F.lit(AS_OF).cast("timestamp_ntz")
    late = changes.filter(C("last_ping") > noon)
    known = merged(session_fold, changes.filter(C("last_ping") <= noon))
    return merged(session_fold, known.select(*changes.columns), late, late).select("session_id", "user_id", "country_code", stamp("last_ping").alias("last_ping"), stamp("created_at").alias("created_at"))


@query("rate_limited_events", """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS hits,
  count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) > 3 AS rejected FROM events""")
def _(t):
    return ing.rate_limited(t.events, "event_type", "ts", 3, 3600).select("event_id", "hits", "rejected")


_GAP = """g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 14400000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("user_sessions", f"WITH {_GAP} SELECT event_id, user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM g")
def _(t):
    return ing.user_sessions(t.events, "user_id", "ts", 240).select("event_id", "user_id", C("session_no").cast("bigint").alias("session_no"))


@query("current_likes", f"""WITH {EV} SELECT install AS user_id, article_id FROM evn WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2
HAVING arg_max(event_type, (created_at, id)) = 'purchase'""")
def _(t):
    ev = reader_events(t).filter((C("created_at") <= dates.now(AS_OF)) & C("event_type").isin("purchase", "error"))
    changes = ev.select(C("install").alias("user_id"), "article_id", "event_type", "created_at", "id")
    return ing.latest_state(changes, ["user_id", "article_id"], "event_type", ["created_at", "id"], ("purchase",)).select("user_id", "article_id")


@query("new_reports", f"""WITH {EV}, p AS (SELECT DISTINCT install, article_id FROM evn WHERE event_type = 'view'),
f AS (SELECT install, article_id, min(id) AS id FROM evn WHERE event_type = 'error' GROUP BY 1, 2)
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.install = f.install AND p.article_id = f.article_id)""")
def _(t):
    ev = reader_events(t).filter(C("created_at") <= dates.now(AS_OF)).select("install", "article_id", "id", "event_type")
    existing = ev.filter("event_type = 'view'").withColumn("status", F.lit("pending"))
    return ing.new_reports(ev.filter("event_type = 'error'"), existing, ["install", "article_id"], ["id"]).select("install", "article_id", "id")


@query("retained_rows", f"""SELECT count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS blacklist, count(*) FILTER (NOT (ts < {NOW} - INTERVAL 30 DAY AND event_type = 'click')) AS jobs,
  count(*) FILTER (ts >= {NOW} - INTERVAL 90 DAY) AS summaries FROM events""")
def _(t):
    from tidewire.operators.keyed import single_row

    def kept(name, days, only=None):
        return ing.retained(t.events, "ts", AS_OF, days, only).agg(F.count("*").alias(name))

    return single_row(kept("blacklist", 7), kept("jobs", 30, C("event_type") == "click"), kept("summaries", 90))


@query("counter_increments", f"""WITH {EV} SELECT article_id, count(*) FILTER (event_type = 'click') AS read_count, count(*) FILTER (event_type = 'purchase') AS like_count FROM evn GROUP BY 1""")
def _(t):
    ev = reader_events(t).filter(C("created_at") <= dates.now(AS_OF))
    return ing.counter_increments(ev, "article_id", {"read_count": C("event_type") == "click", "like_count": C("event_type") == "purchase"})


# --- streams ----------------------------------------------------------------------------


def _event_stream(t):
    raw = t.spark.readStream.schema(MART_SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.withColumn("ts", C("ts").cast("timestamp"))  # watermarks need a zoned timestamp


def _drain(t, frame, label, mode="append"):
    """Run a stream over what is there and read back its sink."""
    out = scratch_path(t.spark, label)
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").format("parquet").option("path", out)
    q.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_minute_counts", """WITH w AS (SELECT date_trunc('minute', ts) AS s, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n FROM w, m WHERE s + INTERVAL 1 MINUTE <= wm""")
def _(t):
    out = _drain(t, ing.minute_counts(_event_stream(t), "ts"), "minutes")
    return out.select(text_stamp("start").alias("start"), "n")


@query("stream_distinct_events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    twice = _event_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _drain(t, ing.drop_repeats(twice, "event_id", "ts").select("event_id", "event_type"), "distinct")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_session_table", f"WITH {EV} {_HEART}")
def _(t):
    path = scratch_path(t.spark, "session-stream")
    t2 = type(t)(t.spark, t.folder)
    t2.events = _event_stream(t).withColumn("ts", C("ts").cast("timestamp_ntz"))
    ing.stream_into(ing.clean_heartbeats(_pings(t2)), path, session_fold, f"{path}-state").awaitTermination()
    return read_state(t.spark, path, SESSION_STATE, session_fold).select("session_id", "user_id", "country_code", stamp("last_ping").alias("last_ping"), stamp("created_at").alias("created_at"))


@query("stream_interactions", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "interactions")
    def summed(df):
        return df.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))

    counts = _event_stream(t).select("user_id", "event_type", F.lit(1).cast("bigint").alias("n"))
    ing.stream_into(counts, path, summed, f"{path}-state").awaitTermination()
    return read_state(t.spark, path, "user_id bigint, event_type string, n bigint", summed)


@query("stream_user_sessions")
def _(t):
    out = _drain(t, ing.user_sessions_stream(_event_stream(t), "ts", "user_id"), "user-sessions")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


# --- configurable flow ------------------------------------------------------------------


@query("article_flow")
def _(t):
    run = flow.Flow().run(articles(t, wide=True).withColumn("author", F.lit("")))
    return run.select("id", "category", "detected", "sentiment", "quality", F.array_join("keywords", " ").alias("keywords"))


@query("article_flow_report")
def _(t):
    f = flow.Flow()
    f.run(articles(t, wide=True).withColumn("author", F.lit(""))).write.format("noop").mode("overwrite").save()
    return f.report(t.spark)


@query("custom_validators", f"""WITH {ART} SELECT id, upper(language) AS language, concat_ws(',', CASE WHEN length(title) <= 20 THEN 'long_title' END,
  CASE WHEN n_chars <= 1000 THEN 'long_text' END) AS failed FROM art""")
def _(t):
    r = flow.Registry()
    r.transformer("shout", language=lambda: F.upper("language"))
    r.validator("long_title", lambda: F.length("title") > 20)
    r.validator("long_text", lambda: C("n_chars") > 1000)
    return r.apply(articles(t)).select("id", "language", F.array_join("failed", ",").alias("failed"))


# --- small reference joins ----------------------------------------------------------------


@query("nearest_places", """WITH c AS (SELECT n_nationkey AS k, n_name AS name, n_nationkey * 3.0::DOUBLE - 30 AS lat, n_nationkey * 7.0::DOUBLE - 80 AS lon FROM nation),
p AS (SELECT c_custkey, c_acctbal / 200 AS lat, c_acctbal / 100 - 40 AS lon FROM customer),
d AS (SELECT c_custkey, name, k, 2 * 6371.0 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2))) AS km FROM p, c)
SELECT c_custkey, arg_min(name, (km, k)) AS name, round(min(km), 4) AS km FROM d GROUP BY 1""")
def _(t):
    places = t.nation.select(C("n_nationkey").alias("place_id"), C("n_name").alias("name"), (C("n_nationkey") * 3.0 - 30).alias("lat"), (C("n_nationkey") * 7.0 - 80).alias("lon"))
    points = t.customer.select("c_custkey", (C("c_acctbal") / 200).alias("lat"), (C("c_acctbal") / 100 - 40).alias("lon"))
    near = geo.nearest_place(points, places)
    return near.select("c_custkey", "name", F.round("km", 4).alias("km"))


@query("reused_images", f"""WITH {ART}, i AS (SELECT id, url, source_name, 'img' || (id % 300) AS image FROM art), g AS (SELECT image, count(DISTINCT url) AS urls, count(DISTINCT source_name) AS sources FROM i GROUP BY 1)
SELECT id, image, urls, sources FROM i JOIN g USING (image) WHERE urls > 1""")
def _(t):
    df = articles(t).select("id", "url", "source_name", F.concat(F.lit("img"), C("id") % 300).alias("image"))
    return geo.reused_images(df, "image").select("id", "image", "urls", "sources")


@query("fuzzy_names", """WITH d AS (SELECT p_brand AS key FROM part GROUP BY 1), n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part),
e AS (SELECT name, key FROM n JOIN d ON contains(lower(name), lower(key)) OR contains(lower(key), lower(name)))
SELECT name, arg_min(key, (-length(key), key)) AS canonical FROM e GROUP BY 1""")
def _(t):
    names = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name")).distinct()
    known = t.part.select(C("p_brand").alias("key")).distinct().withColumn("canonical", C("key"))
    return geo.canonical_names(names, "name", known).select("name", "canonical").filter(C("canonical").isNotNull())


@query("parsed_dates", f"""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS epoch,
  strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS rfc, strftime({NOW} - to_hours(CAST(user_id % 50 AS INT)), '%Y-%m-%d %H:%M:%S') AS relative FROM events""")
def _(t):
    sec = F.date_trunc("second", C("ts").cast("timestamp"))
    iso, rfc = F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format(sec, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    epoch = F.when(C("event_id") % 2 == 0, F.unix_seconds(sec)).otherwise(F.unix_millis(sec)).cast("string")
    ago = F.concat(C("user_id") % 50, F.lit(" hours ago"))
    return t.events.select("event_id", *[text_stamp(dates.parse_any_date(c, AS_OF)).alias(n) for n, c in
                                         (("iso", iso), ("epoch", epoch), ("rfc", rfc), ("relative", ago))])


@query("resolved_images", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https:' WHEN 1 THEN '' ELSE '' END || CASE page_id % 4 WHEN 0 THEN '//cdn.example.com/a.jpg'
  WHEN 1 THEN regexp_extract(url, '^https?://[^/?#]+') || '/img/b.jpg' WHEN 2 THEN '' ELSE 'http://x.example.com/c.jpg?a=1&b=2' END AS image FROM pages""")
def _(t):
    raw = F.when(C("page_id") % 4 == 0, "https://cdn.example.com/a.jpg").when(C("page_id") % 4 == 1, "/img/b.jpg").when(
        C("page_id") % 4 == 2, "data:image/png;base64,xx").otherwise("http://x.example.com/c.jpg?a=1&amp;b=2")
    return t.pages.select("page_id", ux.resolve_image(raw, C("url")).alias("image"))


@query("word_set_operations", f"""WITH {ART}, w AS (SELECT id, list_distinct({sq.tokens('title')}) AS a, list_distinct({sq.tokens('summary')}) AS b FROM art)
SELECT id, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS total, round({sq.jaccard('a', 'b')}, 6) AS jaccard FROM w""")
def _(t):
    a, b = F.array_distinct(tx.tokens(C("title"))), F.array_distinct(tx.tokens(C("summary")))
    return articles(t).select("id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("total"),
                              F.round(tx.jaccard(a, b), 6).alias("jaccard"))
