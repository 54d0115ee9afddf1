"""Engagement reports over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import engagement as eng
from tidewire.plans.views import AS_OF, BINDING, EV, NOW, SESSIONS, install_sessions, reader_events
from tidewire.registry import query

H24 = f"created_at >= {NOW} - INTERVAL 24 HOUR"
D7 = f"created_at >= {NOW} - INTERVAL 7 DAY"
TODAY = f"created_at >= date_trunc('day', {NOW})"


@query("event_type_totals", f"""WITH {EV}
SELECT event_type, CAST(count(*) FILTER ({H24}) AS BIGINT) AS c24, CAST(count(*) FILTER ({D7}) AS BIGINT) AS c7,
  count(*) AS c_all FROM evn GROUP BY event_type""")
def _(t):
    return eng.event_type_totals(reader_events(t), AS_OF, BINDING)


@query("window_uniques", f"""WITH {EV}
SELECT count(DISTINCT session_id) FILTER ({H24}) AS sessions24, count(DISTINCT user_id) FILTER ({H24}) AS users24,
  count(DISTINCT session_id) FILTER ({D7}) AS sessions7,
  count(DISTINCT session_id) FILTER ({TODAY}) AS sessions_today,
  count(DISTINCT user_id) FILTER ({TODAY}) AS logged_today FROM evn""")
def _(t):
    return eng.window_uniques(reader_events(t), AS_OF, BINDING)


def _today(kind, name):
    return f"count(*) FILTER (event_type = '{kind}' AND {TODAY}) AS {name}"


@query("engagement_today", f"""WITH {EV}
SELECT {_today('view', 'opens_today')}, {_today('click', 'reads_today')},
  count(*) FILTER (event_type = 'click') AS reads_24h, {_today('purchase', 'likes_today')},
  {_today('save', 'saves_today')}, {_today('comment', 'comments_today')}, {_today('share', 'shares_today')},
  {_today('error', 'searches_today')}, {_today('signup', 'app_opens_today')},
  count(*) FILTER ({TODAY}) AS events_today, count(*) AS events_24h,
  CAST(coalesce(floor(avg(duration_ms) FILTER (event_type = 'click' AND {TODAY})), 0) AS BIGINT) AS avg_read_today,
  count(DISTINCT session_id) AS sessions_24h, count(DISTINCT user_id) FILTER ({TODAY}) AS logged_today
FROM evn WHERE {H24}""")
def _(t):
    return eng.engagement_today(reader_events(t), AS_OF, BINDING)


@query("events_per_minute_30m", f"""WITH {EV}
SELECT strftime(created_at, '%H:%M') AS minute, count(*) AS n FROM evn
WHERE created_at >= {NOW} - INTERVAL 30 MINUTE GROUP BY 1""")
def _(t):
    return eng.minute_series(reader_events(t), AS_OF, BINDING)


@query("top_articles_7d", f"""WITH {EV}
SELECT article_id, article_title, category, count(*) FILTER (event_type = 'view') AS opens,
  count(*) FILTER (event_type = 'click') AS read_count,
  round(avg(duration_ms) FILTER (event_type = 'click'), 3) AS avg_read_ms
FROM evn WHERE event_type IN ('view', 'click') AND article_id <> '' AND {D7}
GROUP BY 1, 2, 3 ORDER BY opens DESC, article_id, article_title, category LIMIT 10""")
def _(t):
    return eng.top_articles(reader_events(t), AS_OF, BINDING)


@query("top_categories_7d", f"""WITH {EV}
SELECT category, count(*) AS n FROM evn WHERE event_type = 'view' AND category <> '' AND {D7}
GROUP BY 1 ORDER BY n DESC, category LIMIT 8""")
def _(t):
    return eng.top_categories(reader_events(t), AS_OF, BINDING)


@query("top_search_terms_7d", f"""WITH {EV}
SELECT json_extract_string(metadata, '$.k') AS term, count(*) AS n FROM evn
WHERE event_type = 'error' AND {D7} GROUP BY 1 HAVING term IS NOT NULL ORDER BY n DESC, term LIMIT 8""")
def _(t):
    return eng.top_searches(reader_events(t), AS_OF, BINDING)


@query("country_breakdown_24h", f"""WITH {EV}
SELECT country_code, count(*) AS n FROM evn WHERE {H24} GROUP BY 1 ORDER BY n DESC, country_code LIMIT 10""")
def _(t):
    return eng.country_breakdown(reader_events(t), AS_OF, BINDING)


@query("os_breakdown_24h", f"WITH {EV} SELECT device_os, count(*) AS n FROM evn WHERE {H24} GROUP BY 1")
def _(t):
    return eng.os_breakdown(reader_events(t), AS_OF, BINDING)


_FUNNEL = f"""fun AS (SELECT count(*) FILTER (event_type = 'view') AS opens,
  count(*) FILTER (event_type = 'click') AS reads, count(*) FILTER (event_type = 'purchase') AS likes,
  count(*) FILTER (event_type = 'save') AS saves, count(*) FILTER (event_type = 'comment') AS comments,
  count(*) FILTER (event_type = 'share') AS shares, count(*) FILTER (event_type = 'error') AS searches,
  CAST(coalesce(floor(avg(duration_ms) FILTER (event_type = 'click')), 0) AS BIGINT) AS avg_read_ms
  FROM evn WHERE {D7})"""


@query("engagement_funnel_7d", f"WITH {EV}, {_FUNNEL} SELECT * FROM fun")
def _(t):
    return eng.funnel(reader_events(t), AS_OF, BINDING)


@query("engagement_funnel_7d_long", f"""WITH {EV}, {_FUNNEL}
SELECT step, n FROM (UNPIVOT fun ON opens, reads, likes, saves, comments, shares, searches, avg_read_ms
  INTO NAME step VALUE n)""")
def _(t):
    return eng.funnel_long(reader_events(t), AS_OF, BINDING)


@query("daily_activity_14d", f"""WITH {EV}
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(DISTINCT session_id) AS sessions,
  count(*) FILTER (event_type = 'signup') AS app_opens, count(*) FILTER (event_type = 'click') AS read_count
FROM evn WHERE created_at >= date_trunc('day', {NOW}) - INTERVAL 14 DAY GROUP BY 1""")
def _(t):
    return eng.daily_series(reader_events(t), AS_OF, BINDING)


@query("presence_summary", f"""WITH {SESSIONS}
SELECT count(*) FILTER (last_ping >= {NOW} - INTERVAL 120 SECOND) AS live,
  count(*) FILTER (last_ping >= {NOW} - INTERVAL 24 HOUR) AS active_24h,
  count(*) FILTER (last_ping >= date_trunc('day', {NOW})) AS dau, count(*) AS total_installs,
  count(*) FILTER (created_at >= date_trunc('day', {NOW})) AS new_installs_today FROM sess""")
def _(t):
    return eng.presence(install_sessions(t), AS_OF)


@query("live_sessions_120s", f"""WITH {SESSIONS}
SELECT count(*) AS live FROM sess WHERE last_ping >= {NOW} - INTERVAL 120 SECOND""")
def _(t):
    return eng.live_count(install_sessions(t), AS_OF)


@query("sessions_by_os", f"WITH {SESSIONS} SELECT device_os, count(*) AS n FROM sess GROUP BY 1")
def _(t):
    return eng.sessions_by_os(install_sessions(t))


@query("sessions_by_country_top10", f"""WITH {SESSIONS}
SELECT country, country_code, count(*) AS n FROM sess GROUP BY 1, 2
ORDER BY n DESC, country_code, country LIMIT 10""")
def _(t):
    return eng.sessions_by_country(install_sessions(t))


@query("daily_installs_30d", f"""WITH {SESSIONS}
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(DISTINCT session_id) AS active_count,
  count(*) AS installs_count FROM sess WHERE created_at >= date_trunc('day', {NOW}) - INTERVAL 30 DAY GROUP BY 1""")
def _(t):
    return eng.daily_installs(install_sessions(t), AS_OF, days=30)


@query("hourly_activity_24h", f"""WITH {SESSIONS}
SELECT CAST(hour(last_ping) AS BIGINT) AS hour, count(*) AS n FROM sess
WHERE last_ping >= {NOW} - INTERVAL 24 HOUR GROUP BY 1""")
def _(t):
    return eng.hourly_activity(install_sessions(t), AS_OF)


@query("hourly_activity_24h_by_stamp", f"""WITH {SESSIONS}
SELECT strftime(date_trunc('hour', last_ping), '%Y-%m-%d %H:%M:%S') AS hour_ts, count(*) AS n FROM sess
WHERE last_ping >= {NOW} - INTERVAL 24 HOUR GROUP BY 1""")
def _(t):
    return eng.hourly_activity(install_sessions(t), AS_OF, split_days=True)


@query("trending_searches_by_language", f"""WITH {EV},
c AS (SELECT CASE WHEN install % 2 = 0 THEN 'ar' ELSE 'en' END AS language,
  json_extract_string(metadata, '$.k') AS term, count(*) AS n FROM evn WHERE event_type = 'error' GROUP BY 1, 2)
SELECT language, term, n, total FROM (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, term) AS r,
    CAST(sum(n) OVER (PARTITION BY language) AS BIGINT) AS total FROM c WHERE term IS NOT NULL) WHERE r <= 10""")
def _(t):
    lang = F.when(F.col("install") % 2 == 0, "ar").otherwise("en")
    return eng.trending_searches(reader_events(t), AS_OF, BINDING, lang)


@query("recent_events_2h", f"""WITH {EV}
SELECT id, event_type, article_title, category, device_os, country_code, duration_ms FROM evn
WHERE created_at >= {NOW} - INTERVAL 2 HOUR ORDER BY id DESC LIMIT 20""")
def _(t):
    return eng.recent_events(reader_events(t), AS_OF, BINDING).select(
        "id", "event_type", "article_title", "category", "device_os", "country_code", "duration_ms")


@query("recent_typed_events", f"""WITH {EV}
SELECT id, event_type, article_title, category, duration_ms FROM evn WHERE event_type IN ('view', 'click', 'purchase')
ORDER BY id DESC LIMIT 12""")
def _(t):
    return eng.recent_typed_events(reader_events(t), AS_OF, ["view", "click", "purchase"], BINDING).select(
        "id", "event_type", "article_title", "category", "duration_ms")


@query("follow_counts", f"""WITH {EV}, f AS (SELECT DISTINCT install AS a, CAST(article_id AS BIGINT) AS b FROM evn
  WHERE event_type = 'purchase'),
e AS (SELECT a AS user_id, 1 AS o, 0 AS i FROM f UNION ALL SELECT b, 0, 1 FROM f)
SELECT user_id, CAST(sum(o) AS BIGINT) AS following, CAST(sum(i) AS BIGINT) AS followers FROM e GROUP BY 1""")
def _(t):
    likes = eng.since(reader_events(t), AS_OF, None, BINDING).filter("event_type = 'purchase'")
    follows = likes.select(
        F.col("install").alias("follower_id"), F.col("article_id").cast("bigint").alias("following_id")
    ).distinct()
    return eng.follow_counts(follows)


@query("like_counts", f"""WITH {EV}
SELECT article_id, count(*) AS likes FROM (SELECT DISTINCT install, article_id FROM evn WHERE event_type = 'purchase')
GROUP BY 1""")
def _(t):
    likes = eng.since(reader_events(t), AS_OF, None, BINDING).filter("event_type = 'purchase'")
    return eng.count_per(likes.select("install", "article_id").distinct(), "article_id", "likes")


@query("liked_flags", f"""WITH {EV},
w AS (SELECT DISTINCT install, article_id FROM evn WHERE event_type = 'view'),
l AS (SELECT DISTINCT install, article_id FROM evn WHERE event_type = 'purchase')
SELECT w.install, w.article_id, l.install IS NOT NULL AS liked FROM w LEFT JOIN l USING (install, article_id)""")
def _(t):
    ev = eng.since(reader_events(t), AS_OF, None, BINDING)
    wanted = ev.filter("event_type = 'view'").select("install", "article_id").distinct()
    liked = ev.filter("event_type = 'purchase'")
    return eng.bridge_flags(wanted, liked, ["install", "article_id"], "liked")
