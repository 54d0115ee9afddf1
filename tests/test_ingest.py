"""Ingestion rules, keyed tables and batch = stream."""

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import text as tx
from tidewire.schemas import EVENT_POST, HEARTBEAT, SOURCE_CATALOGUE
from tidewire.sources import feeds
from tidewire.sources.keyed_table import SESSION_STATE, last_write_wins, merged, read_state, session_fold, write_batch
from tidewire.streaming import ingest

NOON = datetime(2024, 1, 30, 12)


def posts(spark, rows):
    import json

    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return text.select(F.from_json("j", EVENT_POST).alias("p"), F.lit(NOON).cast("timestamp_ntz").alias("arrived")).select("p.*", "arrived")


def test_event_rules(spark):
    rows = [
        {"sessionId": " s1 ", "countryCode": "xx", "events": [
            {"type": "article_read", "ts": 1706608800123, "articleId": "", "durationMs": -5, "metadata": "{\"a\": 1}"},
            {"type": "nonsense"}, {"type": "like", "duration_ms": 99999999999, "metadata": "{broken"}]},
        {"session_id": "s2", "type": "search", "countryCode": "fr", "userId": "u"},
        {"sessionId": "s3", "events": [{"type": "like"}] * 250},
    ]
    got = ingest.clean_events(posts(spark, rows), "arrived").collect()
    one = [r for r in got if r.session_id == "s1"]
    assert [(r.event_type, r.article_id, r.duration_ms, r.metadata, r.country_code) for r in one] == [
        ("article_read", None, 0, '{"a": 1}', "EG"), ("like", None, 86_400_000, None, "EG")]
    assert one[0].created_at == datetime(2024, 1, 30, 10, 0) and one[1].created_at == NOON
    assert [(r.event_type, r.user_id, r.country_code) for r in got if r.session_id == "s2"] == [("search", "u", "FR")]
    assert sum(r.session_id == "s3" for r in got) == 250
    limited = ingest.clean_events(posts(spark, rows), "arrived", max_events=200)
    assert limited.filter("session_id = 's3'").count() == 200


def test_session_state(spark):
    rows = [("a", None, "u1", "ios", None, "1", "sa", 0, datetime(2024, 1, 1, 10), 1), ("a", None, "", "android", None, "2", "zz", 1, datetime(2024, 1, 2, 10), 2),
            ("b", None, None, None, "web", None, "", 0, datetime(2024, 1, 2, 11), 3)]
    changes = ingest.clean_heartbeats(spark.createDataFrame(rows, HEARTBEAT))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write_batch(changes.filter("ping_id = 1"), path, "s", 0, session_fold)
    write_batch(changes.filter("ping_id > 1"), path, "s", 1, session_fold)
    before = {r.session_id: r for r in read_state(spark, path, SESSION_STATE, session_fold).collect()}
    once = merged(session_fold, changes)
    again = {r.session_id: r for r in merged(session_fold, once.select(*changes.columns), changes).select(*once.columns).collect()}
    assert {k: r.asDict() for k, r in before.items()} == {k: r.asDict() for k, r in again.items()}
    assert before["a"].user_id == "u1" and before["a"].device_os == "android" and before["a"].created_at == datetime(2024, 1, 1, 10)
    assert before["a"].country_code == "ZZ" and before["b"].country == "مصر"


def test_retried_batch_changes_nothing(spark):
    path, fold = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), last_write_wins(["k"], ["n"])
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, n bigint")
    for _ in range(2):
        write_batch(df, path, "s", 7, fold)
    assert sorted(map(tuple, read_state(spark, path, "k string, n bigint", fold).collect())) == [("a", 3), ("b", 2)]
    assert spark.read.parquet(path).count() == 2


def test_streams_go_on_after_a_restart_and_do_not_hide_each_other(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def summed(df):
        return df.groupBy("k").agg(F.sum("n").alias("n"))

    def run(checkpoint):
        source = spark.readStream.schema("k string, n bigint").parquet(f"{root}/in")
        ingest.stream_into(source, f"{root}/out", summed, f"{root}/{checkpoint}").awaitTermination()
        return sorted(map(tuple, read_state(spark, f"{root}/out", "k string, n bigint", summed).collect()))

    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, n bigint").write.parquet(f"{root}/in")
    assert run("one") == [("a", 4), ("b", 2)] == run("one")
    spark.createDataFrame([("a", 10)], "k string, n bigint").write.mode("append").parquet(f"{root}/in")
    assert run("one") == [("a", 14), ("b", 2)]
    assert run("two") == [("a", 28), ("b", 4)]  # reads all again, into partitions of its own


def test_long_metadata_is_kept_whole(spark):
    long = '{"a": "' + "x" * 9000 + '"}'
    df = spark.createDataFrame([(1, long), (2, long[:-1]), (3, ""), (4, None)], "id int, m string")
    got = df.select("id", tx.valid_metadata(F.col("m")).alias("whole"), tx.valid_metadata(F.col("m"), 8000).alias("narrow")).orderBy("id").collect()
    assert [(r.whole, r.narrow) for r in got] == [(long, None), (None, None), (None, None), (None, None)]


def test_stream_counts_equal_batch(spark, tables):
    batch = tables.events.groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.count("*").alias("n"))
    want = {(r.m.isoformat(), r.n) for r in batch.collect()}
    raw = spark.readStream.schema(tables.events.schema).option("pathGlobFilter", "events.parquet").parquet(tables.folder)
    stream = ingest.minute_counts(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    q = stream.writeStream.format("memory").queryName("minutes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start.isoformat(), r.n) for r in spark.table("minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n").collect()}
    assert got <= want and len(got) >= len(want) - 5


def test_sessions_over_midnight(spark):
    times = [datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 2, 0, 10), datetime(2024, 1, 2, 1, 0), datetime(2024, 1, 4, 1, 0), datetime(2024, 1, 4, 1, 20)]
    df = spark.createDataFrame([(1, t) for t in times], "u int, ts timestamp_ntz")
    got = [r.session_no for r in ingest.user_sessions(df, "u", "ts").orderBy("ts").collect()]
    assert got == [1, 1, 2, 3, 3]


def test_rate_limit(spark):
    df = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 20, 59)] + [("k", datetime(2024, 1, 1, 0, 1, 0))], "k string, ts timestamp_ntz")
    got = [(r.hits, r.rejected) for r in ingest.rate_limited(df, "k", "ts", 3).orderBy("ts").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True)]


def test_nested_sources(spark):
    text = '{"countries":[{"country":"Morocco","country_code":"MA","sources":[{"name":"A","url":"u","category":"c","type":"t","language":["ar","fr"],"rank":1},{"name":"B","rank":2}]}]}'
    df = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", SOURCE_CATALOGUE).alias("x")).select("x.*")
    assert [(r.country, r.name, r.language, r["rank"]) for r in feeds.flatten_sources(df).collect()][:1] == [("Morocco", "A", "ar,fr", 1)]
    assert feeds.flatten_sources(df).count() == 2


def test_feed_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/a.xml", "w") as f:
        f.write("<rss><channel><item><title><![CDATA[A <b>story</b>]]></title><link>https://x.example.com/a</link><description>d</description>"
                "<pubDate>Mon, 15 Jan 2024 10:30:00 GMT</pubDate><enclosure url='https://x.example.com/a.jpg' type='image/jpeg'/></item>"
                "<item><title></title><link>https://x.example.com/b</link></item></channel></rss>")
    [row] = feeds.read_feed_files(spark, folder, NOON).collect()
    assert (row.title, row.url, row.image_url) == ("A story", "https://x.example.com/a", "https://x.example.com/a.jpg")
