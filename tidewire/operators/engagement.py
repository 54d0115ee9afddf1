"""Engagement analytics over an event log, at a given moment ``as_of``.

Rows later than ``as_of`` never count. Each report is one scan with partial
aggregation; windows that bound the past also bound the scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.bindings import EventBinding, moment
from tidewire.operators.keyed import single_row, top_per_key

DEFAULT = EventBinding()


def _midnight(as_of: datetime) -> datetime:
    return as_of.replace(hour=0, minute=0, second=0, microsecond=0)


def since(events: DataFrame, as_of: datetime, back: timedelta | None, b: EventBinding = DEFAULT) -> DataFrame:
    """Events of the last ``back`` (or of all time) up to ``as_of``; both bounds reach the scan."""
    out = events.filter(F.col(b.time) <= moment(events, b.time, as_of))
    if back is not None:
        out = out.filter(F.col(b.time) >= moment(events, b.time, as_of - back))
    return out


def _after(events: DataFrame, b: EventBinding, start: datetime) -> Column:
    return F.col(b.time) >= moment(events, b.time, start)


def _mean_int(value: Column) -> Column:
    """Mean cut to a whole number, zero when there is nothing to average."""
    return F.coalesce(F.floor(F.avg(value)), F.lit(0)).cast("bigint")


def event_type_totals(events, as_of, b=DEFAULT):
    df = since(events, as_of, None, b)
    return df.groupBy(F.col(b.type).alias("event_type")).agg(
        F.count_if(_after(df, b, as_of - timedelta(hours=24))).alias("c24"),
        F.count_if(_after(df, b, as_of - timedelta(days=7))).alias("c7"),
        F.count("*").alias("c_all"),
    )


def _last_seen(df: DataFrame, b: EventBinding) -> DataFrame:
    """Latest time of each session and each user: distinct counts of any recent window follow from it."""
    keys = F.array(
        F.struct(F.lit("session").alias("kind"), F.col(b.session).cast("string").alias("key")),
        F.struct(F.lit("user").alias("kind"), F.col(b.user).cast("string").alias("key")),
    )
    return (
        df.select(F.col(b.time).alias("at"), F.inline(keys))
        .filter(F.col("key").isNotNull())
        .groupBy("kind", "key")
        .agg(F.max("at").alias("at"))
    )


def window_uniques(events, as_of, b=DEFAULT):
    """Distinct sessions and users per window, from one pass over (kind, key) -> last time.

    A key is in the window [x, as_of] exactly when its last time is >= x, so no
    per-window DISTINCT expansion is needed.
    """
    df = since(events, as_of, timedelta(days=7), b)
    seen = _last_seen(df, b)
    at = F.col("at")
    day, today = moment(df, b.time, as_of - timedelta(hours=24)), moment(df, b.time, _midnight(as_of))
    session, user = F.col("kind") == "session", F.col("kind") == "user"
    return seen.agg(
        F.count_if(session & (at >= day)).alias("sessions24"),
        F.count_if(user & (at >= day)).alias("users24"),
        F.count_if(session).alias("sessions7"),
        F.count_if(session & (at >= today)).alias("sessions_today"),
        F.count_if(user & (at >= today)).alias("logged_today"),
    )


def window_uniques_approx(events, as_of, b=DEFAULT, rsd: float = 0.02):
    """The same counts by HyperLogLog, for when no exact shuffle of the keys is wanted."""
    df = since(events, as_of, timedelta(days=7), b)
    day, today = _after(df, b, as_of - timedelta(hours=24)), _after(df, b, _midnight(as_of))

    def uniques(cond, col):
        return F.approx_count_distinct(F.when(cond, F.col(col)), rsd)

    return df.agg(
        uniques(day, b.session).alias("sessions24"),
        uniques(day, b.user).alias("users24"),
        F.approx_count_distinct(b.session, rsd).alias("sessions7"),
        uniques(today, b.session).alias("sessions_today"),
        uniques(today, b.user).alias("logged_today"),
    )


def engagement_today(events, as_of, b=DEFAULT):
    """One wide row: actions of today, last-24-hour totals, uniques and mean reading time."""
    df = since(events, as_of, timedelta(hours=24), b)
    today = _after(df, b, _midnight(as_of))

    def n(role):
        return F.count_if(b.is_role(role) & today)

    counts = df.agg(
        n("open").alias("opens_today"),
        n("read").alias("reads_today"),
        F.count_if(b.is_role("read")).alias("reads_24h"),
        n("like").alias("likes_today"),
        n("save").alias("saves_today"),
        n("comment").alias("comments_today"),
        n("share").alias("shares_today"),
        n("search").alias("searches_today"),
        n("app_open").alias("app_opens_today"),
        F.count_if(today).alias("events_today"),
        F.count("*").alias("events_24h"),
        _mean_int(F.when(b.is_role("read") & today, F.col(b.duration))).alias("avg_read_today"),
    )
    uniq = _last_seen(df, b).agg(
        F.count_if(F.col("kind") == "session").alias("sessions_24h"),
        F.count_if(
            (F.col("kind") == "user") & (F.col("at") >= moment(df, b.time, _midnight(as_of)))
        ).alias("logged_today"),
    )
    return single_row(counts, uniq)


def minute_series(events, as_of, b=DEFAULT, minutes: int = 30):
    df = since(events, as_of, timedelta(minutes=minutes), b)
    return df.groupBy(F.date_format(b.time, "HH:mm").alias("minute")).agg(F.count("*").alias("n"))


def top_articles(events, as_of, b=DEFAULT, k: int = 10):
    df = since(events, as_of, timedelta(days=7), b).filter(
        F.col(b.type).isin(b.roles["open"], b.roles["read"]) & (F.coalesce(F.col(b.article), F.lit("")) != "")
    )
    return (
        df.groupBy(
            F.col(b.article).alias("article_id"), F.col(b.title).alias("article_title"),
            F.col(b.category).alias("category"),
        )
        .agg(
            F.count_if(b.is_role("open")).alias("opens"),
            F.count_if(b.is_role("read")).alias("read_count"),
            F.round(F.avg(F.when(b.is_role("read"), F.col(b.duration))), 3).alias("avg_read_ms"),
        )
        .orderBy(F.desc("opens"), "article_id", "article_title", "category")
        .limit(k)
    )


def top_categories(events, as_of, b=DEFAULT, k: int = 8):
    df = since(events, as_of, timedelta(days=7), b).filter(
        b.is_role("open") & (F.coalesce(F.col(b.category), F.lit("")) != "")
    )
    return (
        df.groupBy(F.col(b.category).alias("category")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category").limit(k)
    )


def search_terms(events, as_of, b=DEFAULT, back: timedelta | None = timedelta(days=7)):
    return (
        since(events, as_of, back, b)
        .filter(b.is_role("search"))
        .select("*", F.get_json_object(b.metadata, b.term_path).alias("term"))
        .filter(F.col("term").isNotNull())
    )


def top_searches(events, as_of, b=DEFAULT, k: int = 8):
    return (
        search_terms(events, as_of, b).groupBy("term").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "term").limit(k)
    )


def trending_searches(events, as_of, b=DEFAULT, language: Column | None = None, k: int = 10):
    """Most searched terms of each language, with the language's total of listed searches."""
    lang = language if language is not None else F.lit("")
    counted = (
        search_terms(events, as_of, b, None)
        .groupBy(lang.alias("language"), "term")
        .agg(F.count("*").alias("n"))
    )
    top = top_per_key(counted, ["language"], [F.desc("n"), F.asc("term")], k)
    total = counted.groupBy("language").agg(F.sum("n").alias("total"))
    return top.join(total, "language")


def country_breakdown(events, as_of, b=DEFAULT, k: int = 10):
    return (
        since(events, as_of, timedelta(hours=24), b)
        .groupBy(F.col(b.country).alias("country_code")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "country_code").limit(k)
    )


def os_breakdown(events, as_of, b=DEFAULT):
    return (
        since(events, as_of, timedelta(hours=24), b)
        .groupBy(F.col(b.os).alias("device_os")).agg(F.count("*").alias("n"))
    )


def funnel(events, as_of, b=DEFAULT):
    df = since(events, as_of, timedelta(days=7), b)
    return df.agg(
        F.count_if(b.is_role("open")).alias("opens"),
        F.count_if(b.is_role("read")).alias("reads"),
        F.count_if(b.is_role("like")).alias("likes"),
        F.count_if(b.is_role("save")).alias("saves"),
        F.count_if(b.is_role("comment")).alias("comments"),
        F.count_if(b.is_role("share")).alias("shares"),
        F.count_if(b.is_role("search")).alias("searches"),
        _mean_int(F.when(b.is_role("read"), F.col(b.duration))).alias("avg_read_ms"),
    )


def funnel_long(events, as_of, b=DEFAULT):
    """The funnel as (step, n) rows."""
    wide = funnel(events, as_of, b)
    return wide.unpivot([], [c for c in wide.columns], "step", "n")


def daily_series(events, as_of, b=DEFAULT, days: int = 14):
    """Per date: distinct sessions, app opens and reads; the lower bound is inclusive, so days + 1 dates."""
    start = _midnight(as_of) - timedelta(days=days)
    df = since(events, as_of, None, b).filter(_after(events, b, start))
    per_session = df.groupBy(F.to_date(b.time).alias("day"), F.col(b.session).alias("session")).agg(
        F.count_if(b.is_role("app_open")).alias("app_opens"),
        F.count_if(b.is_role("read")).alias("read_count"),
    )
    return per_session.groupBy(F.col("day").cast("string").alias("date")).agg(
        F.count("session").alias("sessions"),
        F.sum("app_opens").alias("app_opens"),
        F.sum("read_count").alias("read_count"),
    )


def recent_events(events, as_of, b=DEFAULT, hours: int = 2, k: int = 20):
    return since(events, as_of, timedelta(hours=hours), b).orderBy(F.desc(b.id)).limit(k)


def recent_typed_events(events, as_of, types: list[str], b=DEFAULT, k: int = 12):
    return (
        since(events, as_of, None, b).filter(F.col(b.type).isin(types)).orderBy(F.desc(b.id)).limit(k)
    )


# --- the session (presence) table -------------------------------------------------


def presence(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Live, active, daily active, total and new installs; session_id is unique in the table."""
    today = moment(sessions, "last_ping", _midnight(as_of))
    made = moment(sessions, "created_at", _midnight(as_of))
    ping = F.col("last_ping")
    return sessions.agg(
        F.count_if(ping >= moment(sessions, "last_ping", as_of - timedelta(seconds=120))).alias("live"),
        F.count_if(ping >= moment(sessions, "last_ping", as_of - timedelta(hours=24))).alias("active_24h"),
        F.count_if(ping >= today).alias("dau"),
        F.count("*").alias("total_installs"),
        F.count_if(F.col("created_at") >= made).alias("new_installs_today"),
    )


def live_count(sessions: DataFrame, as_of: datetime, seconds: int = 120) -> DataFrame:
    fresh = F.col("last_ping") >= moment(sessions, "last_ping", as_of - timedelta(seconds=seconds))
    return sessions.filter(fresh).agg(F.count("*").alias("live"))


def sessions_by_os(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("device_os").agg(F.count("*").alias("n"))


def sessions_by_country(sessions: DataFrame, k: int = 10) -> DataFrame:
    return (
        sessions.groupBy("country", "country_code").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "country_code", "country").limit(k)
    )


def daily_installs(sessions: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    start = moment(sessions, "created_at", _midnight(as_of) - timedelta(days=days))
    return (
        sessions.filter(F.col("created_at") >= start)
        .groupBy(F.to_date("created_at").cast("string").alias("date"))
        .agg(F.count("session_id").alias("active_count"), F.count("*").alias("installs_count"))
    )


def hourly_activity(sessions: DataFrame, as_of: datetime, split_days: bool = False) -> DataFrame:
    """Sessions by hour of their last ping over 24 h; ``split_days`` keeps the two partial hours apart."""
    df = sessions.filter(F.col("last_ping") >= moment(sessions, "last_ping", as_of - timedelta(hours=24)))
    hour = F.hour("last_ping").cast("bigint").alias("hour")
    if split_days:
        stamp = F.date_format(F.date_trunc("hour", "last_ping"), "yyyy-MM-dd HH:mm:ss").alias("hour_ts")
        return df.groupBy(stamp).agg(F.count("*").alias("n"))
    return df.groupBy(hour).agg(F.count("*").alias("n"))


# --- bridges ----------------------------------------------------------------------


def follow_counts(follows: DataFrame, follower: str = "follower_id", following: str = "following_id") -> DataFrame:
    """Following and follower counts per user, in one aggregate over both ends of each edge."""
    ends = follows.select(
        F.inline(
            F.array(
                F.struct(F.col(follower).alias("user_id"), F.lit(1).alias("out"), F.lit(0).alias("inn")),
                F.struct(F.col(following).alias("user_id"), F.lit(0).alias("out"), F.lit(1).alias("inn")),
            )
        )
    )
    return ends.groupBy("user_id").agg(F.sum("out").alias("following"), F.sum("inn").alias("followers"))


def count_per(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def bridge_flags(wanted: DataFrame, bridge: DataFrame, keys: list[str], name: str) -> DataFrame:
    """For each wanted (user, article): is it in the bridge?"""
    known = bridge.select(*keys).distinct().withColumn(name, F.lit(True))
    return wanted.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
