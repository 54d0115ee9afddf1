"""Date and freshness expressions relative to an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper age in hours of each freshness class, most urgent first.
FRESHNESS_HOURS = (("very_fresh", 1), ("fresh", 6), ("recent", 24), ("older", 48), ("backfill", 72))
FRESHNESS_ORDER = ("very_fresh", "fresh", "recent", "older", "backfill", "archive", "unknown_date")


def now(as_of: datetime, ntz: bool = True) -> Column:
    literal = F.lit(as_of)
    return literal.cast("timestamp_ntz") if ntz else literal


def days_before(as_of: datetime, days: int) -> Column:
    """Midnight ``days`` calendar days before ``as_of``."""
    return F.date_sub(F.lit(as_of.date()), days).cast("timestamp_ntz")


def months_before(as_of: datetime, months: int) -> Column:
    return F.add_months(F.lit(as_of.date()), -months).cast("timestamp_ntz")


def within(published: Column, as_of: datetime, days: int | None = None, months: int | None = None) -> Column:
    """Unknown dates pass, future dates do not, others must be later than the cut-off."""
    cut = days_before(as_of, days) if days is not None else months_before(as_of, months or 0)
    return F.coalesce((published <= now(as_of)) & (published > cut), F.lit(True))


def is_current_event(event_type: Column, category: Column) -> Column:
    kind, cat = F.lower(event_type), F.lower(category)
    return F.coalesce(kind.isin("breaking", "urgent", "live", "breakingnews"), F.lit(False)) | F.coalesce(
        cat.contains("breaking") | cat.contains("عاجل"), F.lit(False)
    )


def fresh_for_feed(
    published: Column, current: Column, as_of: datetime, event_days: int = 30, other_months: int = 3
) -> Column:
    """Current events live 30 days, the rest three months; unknown and future dates stay."""
    cut = F.when(current, days_before(as_of, event_days)).otherwise(months_before(as_of, other_months))
    return F.coalesce((published > now(as_of)) | (published > cut), F.lit(True))


def whole_seconds(first: Column, last: Column) -> Column:
    """Seconds between the whole seconds two times lie in: parts of a second count at neither end."""
    def second(time: Column) -> Column:
        return F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time) / 1_000_000)

    return second(last) - second(first)


def freshness_class(published: Column, as_of: datetime) -> Column:
    age = whole_seconds(published, now(as_of))
    ladder = F.when(published.isNull(), "unknown_date")
    for name, hours in FRESHNESS_HOURS:
        ladder = ladder.when(age <= hours * 3600, name)
    return ladder.otherwise("archive")


def freshness_order(published: Column, as_of: datetime) -> Column:
    cls = freshness_class(published, as_of)
    return F.array_position(F.array(*[F.lit(c) for c in FRESHNESS_ORDER]), cls).cast("int") - 1


def parse_publish_date(raw: Column) -> Column:
    """Ten or more digits are an epoch (milliseconds beyond 1e11, else seconds); otherwise ISO-8601 in UTC."""
    value = F.trim(raw)
    epoch = F.when(value.rlike(r"^\d{10,}$"), value.try_cast("bigint"))
    ms = F.when(epoch > 100_000_000_000, epoch).otherwise(epoch * 1000)
    return F.coalesce(F.timestamp_millis(ms), value.try_cast("timestamp"))


def span_label(first: Column, last: Column) -> Column:
    """Today / n days / n weeks / n months between two times."""
    days = F.floor(whole_seconds(first, last) / 86_400)
    return (
        F.when(days < 1, F.lit("today"))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days")))
        .when(days < 30, F.concat(F.ceil(days / 7).cast("string"), F.lit(" weeks")))
        .otherwise(F.concat(F.ceil(days / 30).cast("string"), F.lit(" months")))
    )


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_rfc2822(raw: Column) -> Column:
    """``Mon, 15 Jan 2024 10:30:00 +0200`` (or a zone name taken as UTC) to a UTC timestamp."""
    pat = r"(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4})?"

    def group(i: int) -> Column:
        return F.regexp_extract(raw, pat, i)

    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(group(2)))
    zone = F.when(group(7) == "", F.lit("+0000")).otherwise(group(7))
    offset = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")) * F.when(
        F.substring(zone, 1, 1) == "-", -1
    ).otherwise(1)
    second = F.when(group(6) == "", F.lit("00")).otherwise(group(6))
    text = F.concat_ws(
        " ",
        F.concat_ws("-", group(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(group(1), 2, "0")),
        F.concat_ws(":", group(4), group(5), second),
    )
    return F.when(
        raw.rlike(pat) & (month > 0),
        text.try_cast("timestamp") - F.make_dt_interval(mins=offset),
    )


def parse_relative(raw: Column, as_of: datetime) -> Column:
    """``3 hours ago`` and the like, counted back from ``as_of``."""
    pat = r"(?i)(\d+)\s*(minute|min|hour|hr|day|week|month|year)s?\s+ago"
    count = F.regexp_extract(raw, pat, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(raw, pat, 2))
    minutes = (
        F.when(unit.isin("minute", "min"), 1).when(unit.isin("hour", "hr"), 60).when(unit == "day", 1440)
        .when(unit == "week", 10080).when(unit == "month", 43200).otherwise(525600)
    )
    return F.when(count.isNotNull(), F.lit(as_of) - F.make_dt_interval(mins=count * minutes))


def parse_any_date(raw: Column, as_of: datetime) -> Column:
    return F.coalesce(parse_publish_date(raw), parse_rfc2822(raw), parse_relative(raw, as_of))
