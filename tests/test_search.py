"""Search over the index equals a plain scan of the fields."""

from pyspark.sql import functions as F

from tidewire.operators import search

ROWS = [(1, "The Cat sat", "on a mat", None, "pets, cats"), (2, "a cat", "the cat", "sat on the cat sat", ""), (3, None, None, "CAT-SAT; the", "é"),
        (4, "the the the cat", "", "x" * 5000 + " the end", "ab"), (5, "", None, None, None)]
SCHEMA = "id bigint, title string, summary string, content string, keywords string"


def test_phrases_stand_in_one_field_in_order(spark):
    index = search.segment(spark.createDataFrame(ROWS, SCHEMA))
    asked = spark.createDataFrame([("the cat",), ("cat sat",), ("the the cat",), ("mat pets",), ("",), ("Sat ON",), ("the cat",)], "phrase string")
    got = {(r.phrase, r.id) for r in search.phrase_hits(index, asked).collect()}
    assert got == {("the cat", 1), ("the cat", 2), ("the cat", 4), ("cat sat", 1), ("cat sat", 2), ("cat sat", 3), ("the the cat", 4), ("Sat ON", 2)}


def test_segments_merge_and_replace(spark):
    old = search.segment(spark.createDataFrame(ROWS, SCHEMA), 0)
    new = search.segment(spark.createDataFrame([(1, "dogs only", None, None, None), (6, "the cat", None, None, None)], SCHEMA), 1)
    asked = spark.createDataFrame([("the cat",), ("dogs only",)], "phrase string")
    got = {(r.phrase, r.id) for r in search.phrase_hits(search.merged(old, new), asked).collect()}
    assert got == {("the cat", 2), ("the cat", 4), ("the cat", 6), ("dogs only", 1)}


def test_substrings_of_any_length(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    needles = ["at s", "CAT", "é", "ab", "x" * 40, "t, c", "s, cats", "", "zz", "b"]
    got = {(r.needle, r.id) for r in search.substring_hits(search.gram_index(rows), rows, spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(n, r[0]) for n in needles if n for r in ROWS if any(n.lower() in (f or "").lower() for f in r[1:])}


def test_texts_are_tokenised_once_however_many_phrases_are_asked(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame([(f"word{i} other{i} third",) for i in range(20)], "phrase string")
    plan = search.phrase_hits(search.segment(rows), asked.withColumn("phrase", F.col("phrase")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= 2 and "Cartesian" not in plan


def test_places_of_words_are_not_shuffled(spark, monkeypatch):
    rows = [(i, "b a b. c " * 50, None, "the end of the end", "") for i in range(20)]
    articles = spark.createDataFrame(rows + rows[:1], "id long, title string, summary string, content string, keywords string")
    index = search.segment(articles)
    assert "Aggregate" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.token, tuple(r.positions)) for r in index.filter("id = 3 and field = 'content'").collect()} == {
        ("the", (0, 3)), ("end", (1, 4)), ("of", (2,))}
    phrases = spark.createDataFrame([("b a b",), ("a b b",), ("b c b a",), ("END of the",), ("end end",), ("b",), ("...",)], "phrase string")
    hits = {(r.phrase, r.id) for r in search.phrase_hits(index, phrases).collect()}
    assert hits == {(p, i) for p in ("b a b", "b c b a", "END of the", "b") for i in range(20)}
    monkeypatch.setattr(search, "FEW", 0)
    assert {(r.phrase, r.id) for r in search.phrase_hits(index, phrases).collect()} == hits
