"""Costly expressions over a text are evaluated once per row, and results stay the same."""

from pyspark.sql import functions as F

from tidewire.functions import scores as sc
from tidewire.operators import corpus as cp
from tidewire.operators import extraction as ex


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_scanned_once_for_its_category(spark):
    df = spark.createDataFrame([(1, "match goal"), (2, "election vote match"), (3, "nothing"), (4, None)], "id long, content string")
    hits = sc.category_hits(F.col("content"))
    for label in (sc.keyword_category, sc.flag_category, sc.weighted_share_category):
        out = df.select("id", label(hits).alias("c")).select("id", "c.category", F.round("c.confidence", 6).alias("confidence"))
        assert plan_of(out).count("lower(content") == 1, label


def test_no_regular_expression_runs_per_word_of_a_sentiment(spark):
    df = spark.createDataFrame([("Not a win, but growth! لا فوز",), ("لم ينجح",), (None,)], "content string")
    out = df.select(sc.sentiment_negated(F.col("content")).alias("s"))
    assert "regexp_replace(lambda" not in plan_of(out)


def test_counting_sorts_without_an_interpreted_comparator(spark):
    df = spark.createDataFrame([("b a, bbًب الكتاب والكتاب b",)], "content string")
    c = F.col("content")
    out = df.select(F.inline(cp.term_vector(F.lit("title"), F.lit(""), c, None)))
    assert "array_sort" not in plan_of(out)
    assert {r.term for r in out.collect()} == {"title", "bbب", "الكتاب", "كتاب", "والكتاب"}


def test_texts_are_not_split_below_the_shuffle_that_spreads_them(spark):
    df = spark.createDataFrame([(1, "c", "word word other")], "id long, cluster string, content string").repartition(4)
    flat = df.select("cluster", ex.keywords(F.col("content"), 3).alias("keywords"))
    sentences = df.select("cluster", "id", "content")
    for out in (cp.merged_terms(flat, "cluster", "keywords"), cp.cluster_sentences(sentences, "cluster", F.col("id"), F.col("content"), 1, 9)):
        assert "split(" not in plan_of(out).split("Repartition")[1]
        assert out.count()


def test_exact_repeats_of_sentences_need_no_word_sets(spark):
    text = "One sentence here. Another sentence there.  One  sentence here. A third one is there. another sentence there."
    out = spark.createDataFrame([(text,), ("",), (None,)], "content string").select(cp.distinct_sentences(F.col("content")).alias("s"))
    assert "translate(" not in plan_of(out)
    assert [r.s for r in out.collect()] == [["One sentence here.", "Another sentence there.", "A third one is there."], [], None]
