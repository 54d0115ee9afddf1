"""Small fixed cases of the functions, Arabic text included."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, predicates as pr, scores as sc, text as tx, url as ux
from tidewire.operators import corpus, extraction as ex, feed, pages

AS_OF = datetime(2024, 1, 30, 12)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [
    ("مُحَمَّد", "محمد"), ("أحمد إلى آخر", "احمد الي اخر"), ("مدرسة", "مدرسه"), ("مســـاء", "مساء"), ("١٢٣", "123"),
    ("مرحبا، كيف؟", "مرحبا كيف"), ("  a   b ", "a b"),
])
def test_normal_form(spark, raw, want):
    assert one(spark, tx.normalize, raw) == want


@pytest.mark.parametrize("raw,want", [
    ("بالمدرسة", "مدرسة"), ("والكتاب", "كتاب"), ("كاتب", "اتب"), ("ستكتب", "كتب"), ("سيكتب", "يكتب"), ("للابيت", "ابيت"), ("في", "في"), ("story", "story"),
])
def test_light_stem(spark, raw, want):
    assert one(spark, tx.light_stem, raw) == want


@pytest.mark.parametrize("raw,want", [("والكتابات", "كتاب"), ("كتب", "كتب"), ("المدرسين", "مدرس"), ("house", "house")])
def test_affix_stem(spark, raw, want):
    assert one(spark, tx.affix_stem, raw) == want


@pytest.mark.parametrize("url,ok", [
    ("https://news.example.com/politics/2024/03/15/minister-signs-new-treaty", True),
    ("https://www.facebook.com/some-long-post-about-things", False), ("ftp://x.example.com/a-long-article-slug", False),
    ("https://site.example.com/", False), ("https://site.example.com/sports", False), ("https://site.example.com/wp-admin/x", False),
    ("https://site.example.com/privacy", False), ("https://site.example.com/a-long-story-title.pdf", False), ("https://site.example.com/fr/123", False),
    ("https://site.example.com/stories/the-quiet-village-wakes", True), ("", False),
])
def test_article_url(spark, url, ok):
    assert one(spark, ux.is_article_url, url) is ok


def test_url_parts(spark):
    u = "https://www.News.example.com/politics/2024/03/15/breaking-minister-signs-new-treaty.html?utm_source=x&id=4#top"
    assert one(spark, ux.host, u) == "news.example.com"
    assert one(spark, ux.category_hint, u) == "politics"
    assert one(spark, ux.date_hint, u) == "2024-03-15"
    assert one(spark, ux.slug_words, u) == ["breaking", "minister", "signs", "new", "treaty"]
    assert one(spark, ux.canonical, u) == "https://news.example.com/politics/2024/03/15/breaking-minister-signs-new-treaty.html?id=4"
    assert one(spark, ux.priority, u) == 10.0
    assert one(spark, ux.publisher_name, "www.hespress.com") == "هسبريس"


@pytest.mark.parametrize("raw,want", [
    ("2024-01-15T10:30:00Z", datetime(2024, 1, 15, 10, 30)), ("1705314600", datetime(2024, 1, 15, 10, 30)),
    ("1705314600000", datetime(2024, 1, 15, 10, 30)), ("Mon, 15 Jan 2024 12:30:00 +0200", datetime(2024, 1, 15, 10, 30)),
    ("Mon, 15 Jan 2024 10:30:00 GMT", datetime(2024, 1, 15, 10, 30)), ("3 hours ago", datetime(2024, 1, 30, 9)), ("soon", None), ("", None),
])
def test_dates(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(
        F.date_format(dates.parse_any_date(F.col("x"), AS_OF), "yyyy-MM-dd HH:mm:ss").alias("y")).first().y
    assert got == (want.strftime("%Y-%m-%d %H:%M:%S") if want else None)


@pytest.mark.parametrize("hours,want", [(-5, "very_fresh"), (1, "very_fresh"), (5, "fresh"), (20, "recent"), (47, "older"), (71, "backfill"), (100, "archive")])
def test_freshness(spark, hours, want):
    df = spark.createDataFrame([(hours,)], "h int").select((F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("h"))).alias("p"))
    assert df.select(dates.freshness_class(F.col("p"), AS_OF).alias("y")).first().y == want


def test_sentiment(spark):
    assert one(spark, sc.sentiment, "a great win and a bad day, good") == pytest.approx(1 / 3)
    assert one(spark, sc.sentiment_negated, "ليس نجاح") == -1.0
    assert one(spark, sc.sentiment_negated, "نجاح كبير") == 1.0
    assert one(spark, sc.sentiment_weighted, "growth and growth but crisis") == pytest.approx((0.8 + 0.8 - 0.9) / 3)
    assert one(spark, sc.sentiment_flag, "a big loss") == -0.8


def test_language(spark):
    def label(c):
        return tx.language_label(tx.language_scores(c))

    assert one(spark, label, "The minister said that the plan is on the table") == "en"
    assert one(spark, label, "Le ministre est dans la salle avec les autres") == "fr"
    assert one(spark, label, "أعلن الوزير اليوم عن خطة جديدة") == "ar"
    assert one(spark, label, "zzz qqq") == "und"


def test_headlines(spark):
    h = spark.createDataFrame([("Shocking secret scandal exposed by shock report?", "nothing of it here")], "t string, b string").select(
        sc.headline(F.col("t"), F.col("b")).alias("h")).first().h
    assert h.is_sensational and h.is_question and h.mismatch and not h.is_clickbait
    assert one(spark, sc.clickbait, "Wow!!!! Noooooo") == pytest.approx(0.7)


def test_titles(spark):
    assert one(spark, pr.valid_title, "Minister opens a new bridge") is True
    for bad in ("News", "bbc", "......", "عنوان خبر 新闻 测试", "one two"):
        assert one(spark, pr.valid_title, bad) is False
    assert one(spark, pr.title_reason, "Sports") == "generic single-word title"
    assert one(spark, pr.strip_publisher, "Storm hits coast - BBC") == "storm hits coast"


def test_category_match(spark):
    df = spark.createDataFrame([("رياضة", "football", True), ("tech", "technology", True), ("health", "space", False), ("X", "x", True)], "a string, b string, ok boolean")
    assert all(r.m == r.ok for r in df.select(feed.category_match(F.col("a"), F.col("b")).alias("m"), "ok").collect())


def test_extraction(spark):
    def call(fn, text):
        return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first().y

    found = call(lambda c: ex.pattern_entities(c, ex.CONTACT_PATTERNS), "mail a.b@c.org or 555-123-4567 on 1/2/2024, a.b@c.org")
    assert [(e.type, e.value) for e in found] == [("email", "a.b@c.org"), ("phone", "555-123-4567"), ("date", "1/2/2024")]
    ents = call(ex.gazetteer_entities, "زار الرئيس محمد الأمين القاهرة. تعاقد ريال مدريد")
    # the city is part of the longer name found before it
    assert {e.value for e in ents} == {"محمد الأمين القاهرة", "ريال مدريد"}
    claims = call(ex.said_claims, "قال الوزير الجديد أن الخطة سوف تبدأ في العام القادم. نهاية")
    assert claims[0].attributed_to == "الوزير الجديد"
    rows = call(ex.triage, "He said yes. They signed a pact. They agreed again. The sky is blue.")
    assert [r.kind for r in rows] == ["claim", "main_event", "event", "statement"]
    assert call(lambda c: ex.keywords(c, 2), "market market bank the the the bank zoo") == ["bank", "market"]
    kept = spark.createDataFrame([("storm coast", "Storm hits the coast now. Storm hits the coast now. Share on facebook twitter telegram."
                                   " This long sentence talks about something else entirely today.")], "t string, c string").select(
        ex.cleaned_content(F.col("t"), F.col("c")).alias("y")).first().y
    assert kept.kept == ["Storm hits the coast now."] and kept.removed == 3


def test_word_category(spark):
    df = spark.createDataFrame([("Team wins final", "The coach praised the player after the match", "https://x.example.com/sport/a")], "t string, b string, u string")
    row = df.select(ex.word_category(F.col("t"), F.col("b"), F.col("u")).alias("c")).first().c
    assert row.category == "sport"
    row = df.select(ex.word_category(F.col("t"), F.col("b"), F.col("u"), valid_ids=["politics"]).alias("c")).first().c
    assert row.category == "general"


def test_combined_similarity_of_like_articles(spark):
    rows = [(1, "Egypt signs gas deal with Cyprus", "Egypt and Cyprus signed a gas deal in Cairo on Monday"),
            (2, "Egypt and Cyprus sign gas deal", "A gas deal was signed by Egypt and Cyprus in Cairo"),
            (3, "Bakery wins bread prize", "The small bakery in town won a prize for rye bread")]
    df = spark.createDataFrame(rows, "id bigint, title string, content string").select(
        "id", corpus.term_vector(F.col("title"), F.lit(""), F.col("content")).alias("vector"),
        corpus.entity_set(F.col("title"), F.col("content"), F.array().cast("array<string>"), F.lit(""), terms=("egypt", "cyprus", "cairo")).alias("entities"),
        F.array().cast("array<string>").alias("keywords"), F.lit(AS_OF).cast("timestamp_ntz").alias("published_at"),
        tx.significant_words(F.col("title")).alias("title_words"), F.lit("world").alias("category"))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    got = {(r.a, r.b): r.combined for r in corpus.pair_features(pairs, df).collect()}
    assert got[(1, 2)] > 0.5 and got[(1, 3)] < 0.3


HTML = """<html lang="en"><head><title>T</title><meta name="author" content="Ann"><link rel="canonical" href="https://x.example.com/c">
<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2024-01-10T08:00:00Z","image":{"url":"https://x.example.com/i.jpg"}}</script></head>
<body><nav><a href="/a">A</a></nav><article class="story"><h1>Storm hits coast</h1><p class="summary">A strong storm hit the coast on Monday night.</p>
<p>Many homes lost power and the roads were closed for hours, officials said on Tuesday.</p><p>More rain is expected later this week in the whole region.</p>
<img src="/img/storm.jpg" alt="storm coast"></article><footer>All rights reserved</footer></body></html>"""


def test_page_to_article(spark):
    df = spark.createDataFrame([(1, "https://x.example.com/p/q", HTML)], "page_id bigint, url string, html string")
    nodes = pages.with_furniture(pages.with_signals(pages.page_nodes(df)))
    meta = pages.page_metadata(nodes).first()
    assert (meta.language, meta.title, meta.author, meta.canonical_url, meta.schema_type) == ("en", "T", "Ann", "https://x.example.com/c", "NewsArticle")
    best = pages.best_region(pages.article_regions(nodes))
    assert best.first().tag == "article"
    art = pages.rebuilt_articles(pages.region_roles(nodes, best), pages.page_metadata(nodes)).first()
    assert art.title == "Storm hits coast" and len(art.paragraphs) == 3 and art.image == "/img/storm.jpg"
    date = pages.publication_dates(nodes, AS_OF).first()
    assert date.origin == "json_ld" and date.confidence == 0.90
    image = pages.best_images(pages.image_candidates(nodes, df), pages.page_metadata(nodes).select("page_id", F.lit("storm coast").alias("title"))).first()
    assert image.image == "https://x.example.com/img/storm.jpg" and image.score == 4
