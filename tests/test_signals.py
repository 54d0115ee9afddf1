"""Joins by several signals against every pair looked at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import corpus, signals


def articles(spark, seed, n, crowd=0):
    """Random articles; ``crowd`` of them hold the same entities and keywords and are unlike otherwise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = {f"v{int(rng.random() ** 2 * 25)}": float(rng.randint(1, 4)) for _ in range(rng.randint(0, 6))}
        z = math.sqrt(sum(w * w for w in vector.values()))
        some = [sorted({f"{x}{rng.randrange(9)}" for _ in range(rng.randint(0, 4))}) for x in "ekt"]
        rows.append((i, sorted((k, w / z) for k, w in vector.items()), *some, rng.choice([None, *range(0, 90, 7)]),
                     rng.choice([None, "", "general", "Sport", "football", "culture", "politics", "world"])))
    rows += [(n + i, [(f"own{i}", 1.0)], ["a", "b"], ["k"], [f"own{i}"], 1000 * i, f"c{i}") for i in range(crowd)]
    df = spark.createDataFrame(rows, "id bigint, vector array<struct<term:string,weight:double>>, entities array<string>, "
                               "keywords array<string>, title_words array<string>, hours int, category string")
    return df.withColumn("published_at", F.timestamp_seconds(F.col("hours") * 3600).cast("timestamp_ntz")).drop("hours").repartition(3)


def every_pair(df):
    ids = df.select("id")
    return corpus.pair_features(ids.toDF("a").join(ids.toDF("b"), F.col("a") < F.col("b")), df)


def peers(x, y):
    if "general" in (x, y):
        return True
    if x is None or y is None:
        return False
    x, y = x.lower(), y.lower()
    return x == y or any(x in g.split() and y in g.split() for g in corpus.CATEGORY_PEERS)


@pytest.mark.parametrize("t", [0.55, 0.25])
def test_combined_similarity_equals_every_pair(spark, t):
    df = articles(spark, 3, 120)
    got = {(r.a, r.b): round(r.combined, 9) for r in corpus.alike_above(df, t).collect()}
    want = {(r.a, r.b): round(r.combined, 9) for r in every_pair(df).collect() if r.combined > t}
    assert got == want and len(want) > 20


def test_subject_pairs_equal_every_pair(spark):
    df = articles(spark, 5, 150)
    got = {(r.a, r.b): (round(r.title_sim, 9), round(r.cosine, 9)) for r in corpus.subject_pairs(df, 0.45, 0.55).collect()}

    def same(r):
        fit = peers(r.category_a, r.category_b)
        return (r.title_sim >= 0.45 or (r.title_sim >= 0.30 and (r.cosine >= 0.35 or r.entity_sim >= 0.35)) or (r.cosine >= 0.55 and fit)
                or (r.entity_sim >= 0.50 and r.cosine >= 0.30 and (r.title_sim >= 0.18 or fit)))

    want = {(r.a, r.b): (round(r.title_sim, 9), round(r.cosine, 9)) for r in every_pair(df).collect() if same(r)}
    assert got == want and len(want) > 50


def test_candidates_are_not_written_out(spark):
    """A crowd that shares its entities makes 79,800 candidates and no link: none of them may be joined to anything."""
    df = articles(spark, 7, 20, crowd=400)
    for found in (corpus.subject_pairs(df, 0.45, 0.55), corpus.alike_above(df, 0.55)):
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("a >= 20").isEmpty()


def test_blocks_of_few_rows_meet_once(spark):
    df = articles(spark, 9, 60)
    rows = signals.coded(df, corpus.category_peers)
    few, many = (signals.pairs(rows, corpus.CombinedAbove(0.25), n).collect() for n in (1, 7))
    assert len({(r.a, r.b) for r in many}) == len(many) and {(r.a, r.b) for r in few} == {(r.a, r.b) for r in many}
