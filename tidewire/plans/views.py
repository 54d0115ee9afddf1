"""Reader-facing views of the mart tables, as Spark frames and as SQL CTEs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.bindings import EventBinding, moment
from tidewire.registry import Tables
from tidewire.sources.mart import widen

AS_OF = datetime(2024, 1, 30, 12, 0, 0)
NOW = "TIMESTAMP '2024-01-30 12:00:00'"

BINDING = EventBinding(
    term_path="$.k",
    roles={
        "open": "view", "read": "click", "like": "purchase", "app_open": "signup", "search": "error",
        "save": "save", "comment": "comment", "share": "share",
    },
)


def reader_events(t: Tables) -> DataFrame:
    """The event table in the shape of the reader event log."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.col("event_id").alias("id"),
        "event_type",
        F.concat(F.lit("s"), "user_id", F.lit("-"), F.day("ts")).alias("session_id"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.element_at(F.array(F.lit("android"), F.lit("ios"), F.lit("web")), (F.col("user_id") % 3 + 1).cast("int"))
        .alias("device_os"),
        F.concat(F.lit("C"), F.col("user_id") % 12).alias("country_code"),
        k.cast("string").alias("article_id"),
        F.concat(F.lit("Article "), k).alias("article_title"),
        F.when(k % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), k % 8)).alias("category"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("install"),
    )


EV = f"""
ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT event_id AS id, event_type, 's' || user_id || '-' || day(ts) AS session_id,
  CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE user_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device_os,
  'C' || (user_id % 12) AS country_code, CAST(k AS VARCHAR) AS article_id, 'Article ' || k AS article_title,
  CASE WHEN k % 8 = 0 THEN '' ELSE 'c' || (k % 8) END AS category,
  CAST(round(value * 1000) AS BIGINT) AS duration_ms, props AS metadata, ts AS created_at, user_id AS install
  FROM ev0),
evn AS (SELECT * FROM ev WHERE created_at <= {NOW})
"""


def install_sessions(t: Tables) -> DataFrame:
    """One row per install: the session table the heartbeats would have left at AS_OF."""
    ev = reader_events(t)
    ev = ev.filter(F.col("created_at") <= moment(ev, "created_at", AS_OF))
    return ev.groupBy("install", "device_os", "country_code").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_ping")
    ).select(
        F.col("install").cast("string").alias("session_id"), "device_os", "country_code",
        F.concat(F.lit("Country "), "country_code").alias("country"), "created_at", "last_ping",
    )


SESSIONS = EV + """,
sess AS (SELECT CAST(install AS VARCHAR) AS session_id, device_os, country_code,
  'Country ' || country_code AS country, min(created_at) AS created_at, max(created_at) AS last_ping
  FROM evn GROUP BY install, device_os, country_code)
"""


CATEGORIES = ("sports", "politics", "economy", "technology", "health", "culture", "breaking", "general")


def articles(t: Tables, wide: bool = False) -> DataFrame:
    """Documents in the shape of the article table: the first sentence is the title."""
    documents = widen(t.documents) if wide else t.documents
    title = F.trim(F.regexp_extract("text", r"^[^.!?\n]*", 0))
    slug = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}]+", "-"), F.lit("-"))
    hours = ((F.col("doc_id") * 7919) % 3000 - 24).cast("int")
    day = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=hours)
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return documents.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.substring("text", 1, 200).alias("summary"),
        F.col("text").alias("content"), F.col("lang").alias("language"),
        F.element_at(cats, (F.col("doc_id") % 8 + 1).cast("int")).alias("category"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/2024/"),
                 F.col("doc_id") % 12 + 1, F.lit("/"), slug).alias("url"),
        F.when(F.col("doc_id") % 7 != 0, "published").otherwise("draft").alias("status"),
        F.when(F.col("doc_id") % 9 == 0, "breaking").otherwise("").alias("event_type"),
        F.when(F.col("doc_id") % 11 != 0, day).alias("published_at"),
        F.lower(F.regexp_extract(title, r"^[^ ]+", 0)).alias("cluster"), "n_chars",
    )


def wide_articles(t: Tables) -> DataFrame:
    """Articles for CPU-heavy text work."""
    return articles(t, wide=True)


ART = f"""
art0 AS (SELECT *, trim(regexp_extract(text, '^[^.!?\\n]*')) AS title FROM documents),
art AS (SELECT doc_id AS id, title, substr(text, 1, 200) AS summary, text AS content, lang AS language,
  [{', '.join("'" + c + "'" for c in CATEGORIES)}][1 + doc_id % 8] AS category, source AS source_name,
  'https://www.' || source || '.example.com/' || lang || '/2024/' || (doc_id % 12 + 1) || '/' ||
    trim(regexp_replace(lower(title), '[^\\pL]+', '-', 'g'), '-') AS url,
  CASE WHEN doc_id % 7 <> 0 THEN 'published' ELSE 'draft' END AS status,
  CASE WHEN doc_id % 9 = 0 THEN 'breaking' ELSE '' END AS event_type,
  CASE WHEN doc_id % 11 <> 0 THEN {NOW} - to_hours(CAST((doc_id * 7919) % 3000 - 24 AS INT)) END AS published_at,
  lower(regexp_extract(title, '^[^ ]+')) AS "cluster", n_chars
  FROM art0)
"""


def order_news(t: Tables) -> DataFrame:
    """Orders in the role of a news fact that refers to categories and sources by id."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).cast("int").alias("category_id"),
        (F.col("o_custkey") % 120).alias("source_id"), F.concat(F.lit("Order "), "o_orderpriority").alias("title"),
        F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") == "O", "draft").otherwise("published").alias("status"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_custkey") % 2 == 0, "en").otherwise("fr").alias("language"),
        F.lit(None).cast("string").alias("summary"),
    )


NEWS = """
news AS (SELECT o_orderkey AS id, CAST(o_custkey % 30 AS INT) AS category_id, o_custkey % 120 AS source_id,
  'Order ' || o_orderpriority AS title, o_orderdate AS published_at, o_totalprice AS price,
  CASE WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'published' END AS status, o_orderpriority AS category,
  CASE WHEN o_custkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language FROM orders)
"""


def category_dim(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("category_name"))


def source_dim(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))


def line_views(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("article_id"))


def stamp(col) -> F.col:
    """Times leave the queries as text, so every client reads them alike."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def article_events(t: Tables, kind: str) -> DataFrame:
    """Bridge rows (user, article, time): event subjects stand for article ids."""
    ev = reader_events(t)
    return ev.filter(
        (F.col("event_type") == kind) & (F.col("created_at") <= moment(ev, "created_at", AS_OF))
    ).select(
        F.col("id").alias("action_id"), F.col("install").alias("user_id"),
        F.col("article_id").cast("bigint").alias("article_id"), "created_at",
    )


def sql_bridge(kind: str) -> str:
    return (f"(SELECT id AS action_id, install AS user_id, CAST(article_id AS BIGINT) AS article_id, created_at "
            f"FROM evn WHERE event_type = '{kind}')")
