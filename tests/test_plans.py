"""Properties of the plans: what reaches the scan, how groups are cut, what is never planned."""

import io
from contextlib import redirect_stdout
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import corpus, engagement as eng, feed
from tidewire.operators.keyed import top_per_key
from tidewire.plans import views
from tidewire.streaming import ingest


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_time_bounds_and_columns_reach_the_scan(tables):
    text = plan(eng.funnel(views.reader_events(tables), views.AS_OF, views.BINDING))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]


def test_top_per_key_cuts_before_the_shuffle(tables):
    text = plan(top_per_key(tables.events, ["event_type"], [F.desc("ts"), F.asc("event_id")], 3))
    tree = text.split("(1)")[0]
    assert tree.count("WindowGroupLimit") == 2  # one below, one above the exchange


def test_feed_page_is_cut_before_views_are_counted(tables):
    q = feed.FeedQuery(language="en")
    text = plan(feed.feed(views.order_news(tables), q, views.category_dim(tables), views.source_dim(tables), views.line_views(tables)))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text


def test_dimension_is_broadcast_only_when_small(tables):
    small = feed.small_side(tables.nation)
    large = feed.small_side(tables.lineitem, limit_bytes=1000)
    assert small._jdf.queryExecution().logical().toString().count("broadcast") == 1
    assert "broadcast" not in large._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("build", [
    lambda t: corpus.trending_phrases(views.articles(t)),
    lambda t: ingest.user_sessions(t.events, "user_id", "ts"),
    lambda t: ingest.rate_limited(t.events, "event_type", "ts", 3),
    lambda t: feed.related_articles(views.articles(t).select("id", "cluster", "category", "language", "published_at"), "cluster"),
])
def test_no_cartesian_product_and_no_python(tables, build):
    text = plan(build(tables))
    assert "CartesianProduct" not in text and "Python" not in text and "ArrowEval" not in text


def test_related_news_needs_category_and_language(tables):
    with pytest.raises(ValueError):
        feed.feed_filter(views.articles(tables), feed.FeedQuery(category="all", language="en", related=True))


def test_moment_keeps_the_column_type(tables):
    from tidewire.bindings import moment

    col = tables.events.select(moment(tables.events, "ts", datetime(2024, 1, 1)).alias("x"))
    assert col.dtypes == [("x", "timestamp_ntz")]
