"""Findings of round 4."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_linkage import plain_average_link
from test_signals import articles

from tidewire.functions import bags
from tidewire.operators import blocks, corpus, linkage, search, signals, simjoin


def test_first_member_without_words_is_like_no_other(spark):
    word = [{"term": "w", "weight": 1.0}]
    rows = [(1, "a", []), (2, "a", word), (3, "a", word), (4, "b", word), (5, "b", []), (6, "b", word), (7, "c", None), (8, "c", word)]
    df = spark.createDataFrame(rows, "id bigint, cluster string, vector array<struct<term:string,weight:double>>")
    got = {tuple(r) for r in corpus.coherent_clusters(df, "cluster", F.col("id")).collect()}
    assert got == {("a", 0.0, False), ("b", 1.0, True), ("c", 0.0, False)}


def test_a_word_seen_very_often_does_not_overflow(spark):
    df = spark.createDataFrame([([("w", 50_000)],)], "x array<struct<term:string,n:int>>")
    assert df.select(bags.unit_weights(F.col("x"))[0]["weight"]).first()[0] == 1.0


def test_dense_pairs_end_at_the_threshold(spark):
    def at(cosine):
        return [cosine, math.sqrt(1 - cosine * cosine)]

    rows = [(0, [1.0, 0.0]), (1, at(0.35 - 4e-10)), (2, at(0.35 + 4e-10)), (3, [0.35, -math.sqrt(1 - 0.35 ** 2)])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    near = [0.35 - 4e-10, 0.35 + 4e-10]
    got = {(r.id_a, r.id_b) for r in simjoin.dense_cosine_pairs(df, "id", "v", 0.35).collect()}
    assert (0, 2) in got and (0, 1) not in got and near[0] < 0.35 < near[1]


def test_dense_pairs_of_rows_hold_every_copy(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0]), (5, [3.0, 3.0]), (6, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = sorted((r.id_a, r.id_b) for r in simjoin.dense_row_pairs(df, "id", "v", 0.5).collect())
    alike = lambda x, y: x[0] * y[0] + x[1] * y[1] >= 0.5 * math.hypot(*x) * math.hypot(*y)
    assert got == sorted((a, b) for a, x in rows for b, y in rows if a < b < 8 and alike(x, y))


def test_a_few_needles_need_no_index(spark, monkeypatch):
    rows = [(1, "Tax news", None, "The TAXI waits", "a"), (2, "", "x", "Ça va", None), (3, None, None, None, None), (4, "ab", "é", "abc", "tax"), (1, "again", "", "taxi", "")]
    df = spark.createDataFrame(rows, "id bigint, title string, summary string, content string, keywords string")
    asked = spark.createDataFrame([(n,) for n in ("tax", "TAXI", "é", "ça", "a", "bc", "", "nowhere", "tax")], "needle string")
    found = search.substring_hits(search.gram_index(df), df, asked)
    assert "sequence" not in found._jdf.queryExecution().optimizedPlan().toString()  # no runs of characters
    got = sorted(map(tuple, found.collect()))
    assert got == sorted({(n, r[0]) for (n,) in asked.collect() if n for r in rows for s in r[1:] if s and n.lower() in s.lower()})
    monkeypatch.setattr(search, "FEW_NEEDLES", 2)
    assert sorted(map(tuple, search.substring_hits(search.gram_index(df), df, asked).collect())) == got
    assert search.substring_hits(search.gram_index(df), df, asked.limit(0)).collect() == []


def test_blocks_meet_once_in_any_number_of_passes(spark, monkeypatch):
    for n in (1, 2, 4, 7):
        every = [d for some in blocks.passes(n, 10) for d in some]
        met = [{b, (b + d) % n} for b in range(n) for d in every]
        assert sorted(every) == list(range(n // 2 + 1)) and {frozenset(m) for m in met} == {frozenset((a, b)) for a in range(n) for b in range(n)}
    df = articles(spark, 11, 120)
    rows = signals.coded(df, corpus.category_peers).cache()
    sets = rows.select("id", F.col("keywords").alias("codes"))
    keep = lambda found: found.select("a", "b")
    one = sorted(map(tuple, signals.pairs(rows, corpus.CombinedAbove(0.25)).select("a", "b").collect()))
    some = sorted((min(r), max(r)) for r in blocks.similar(sets, 0.4, False).select("a", "b").collect())
    monkeypatch.setattr(blocks, "AT_ONCE", 1)
    parts = signals.pairs(rows, corpus.CombinedAbove(0.25), 5, keep)
    assert len({f.rsplit("/", 1)[0] for f in parts.inputFiles()}) == 3  # each pass was written
    assert sorted(map(tuple, parts.collect())) == one
    assert sorted((min(r), max(r)) for r in blocks.similar(sets, 0.4, False).select("a", "b").collect()) == some


def test_leaders_by_earliest_neighbours_equal_those_of_all_edges(spark, monkeypatch):
    for seed, behind in ((13, 20_000), (17, 0)):
        monkeypatch.setattr(corpus, "BEHIND", behind)
        df = articles(spark, seed, 150)
        rows = signals.coded(df, corpus.category_peers).cache()
        for rule in (corpus.CombinedAbove(0.4), corpus.SameSubject(0.45, 0.55)):
            edges = signals.pairs(rows, rule).select(F.col("a").alias("early"), F.col("b").alias("late"))
            more = spark.createDataFrame([(1, 140), (30, 141), (140, 141)], "early bigint, late bigint")
            for extra in (None, more):
                every = (edges if extra is None else edges.union(extra)).collect()
                want, leads = {}, []
                for i in range(150):
                    near = [e.early for e in every if e.late == i and e.early not in want]
                    if near:
                        want[i] = min(near)
                assert dict(map(tuple, corpus.rule_leaders(rows, rule, extra).collect())) == want and len(want) > 20


def test_vectors_are_weighed_in_shares(spark, monkeypatch):
    rows = [(i, [(f"t{j}", 1.0 + j) for j in range(1, 9) if i % j == 0]) for i in range(60)] + [(60, []), (61, None)]
    df = spark.createDataFrame(rows, "id bigint, terms array<struct<term:string,weight:double>>")
    flat = lambda out: {(r.id, r.term, round(r.weight, 12)) for r in out.select("id", F.inline_outer("terms")).fillna(0.0).collect()}
    one = flat(corpus.idf_weighted(df))
    monkeypatch.setattr(corpus, "WEIGHED", 50)
    assert flat(corpus.idf_weighted(df)) == one and len(one) > 100


def test_names_are_hashed_as_in_spark(spark):
    rows = [(0, 1), (-5, 2 ** 62), (10 ** 12, -7)]
    want = [r[0] for r in spark.createDataFrame(rows, "x bigint, y bigint").select(F.xxhash64("x", "y")).collect()]
    assert linkage._hash(*(np.array(c) for c in zip(*rows))).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_linking_in_memory_equals_merging_the_best_pair(spark, seed):
    rng = random.Random(seed)
    n = 40
    topic, weight = [rng.randrange(6) for _ in range(n)], [rng.choice([1, 1, 1, 4]) for _ in range(n)]
    similarity = {(a, b): round(round(rng.uniform(0.15, 0.75) if topic[a] == topic[b] else rng.uniform(0, 0.3), 2) * linkage.SCALE)
                  for a in range(n) for b in range(a + 1, n)}  # many ties
    sizes = np.array(weight)
    sums = np.array([[similarity.get((min(a, b), max(a, b)), 0) * weight[a] * weight[b] for b in range(n)] for a in range(n)])
    got = dict(enumerate(linkage.linked_in_memory(np.arange(n), sizes, sums, 0.28).tolist()))
    assert got == plain_average_link(spark, n, weight, similarity, 0.28)


def test_stories_in_memory_equal_those_by_rounds(spark, monkeypatch):
    df = articles(spark, 19, 100)
    df = df.unionByName(df.filter("id % 9 = 0").withColumn("id", F.col("id") + 200)).cache()
    small = sorted(map(tuple, corpus.story_clusters(df, 0.4, 0.35).collect()))
    monkeypatch.setattr(corpus, "TOGETHER", 2)
    assert small == sorted(map(tuple, corpus.story_clusters(df, 0.4, 0.35).collect())) and len({c for _, c in small}) < 80


def test_vectors_are_deleted_once_features_are_written(spark, tables):
    from tidewire.plans import corpus as plans
    from tidewire.session import checkpoint_dir

    left = lambda: {f.name for f in os.scandir(checkpoint_dir(spark).removeprefix("file:")) if f.name.startswith("terms-")}
    before = left()
    features = plans._features(tables)
    assert features.count() > 0 and left() == before and all(f.endswith(".zstd.parquet") for f in features.inputFiles())
