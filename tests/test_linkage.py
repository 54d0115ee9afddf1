"""Metric joins and hierarchical clustering against plain versions in memory."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import linkage, metric


def clustered_vectors(seed, n, dims=6, groups=12):
    """Vectors around centres, with copies and equally spaced ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (groups, dims))
    rows = centres[rng.integers(0, groups, n)] + rng.normal(0, 0.4, (n, dims))
    rows[: n // 20] = rows[n // 20: 2 * (n // 20)]  # copies
    rows[-20:] = np.arange(20)[:, None] * np.eye(dims)[0]  # ties
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)


@pytest.mark.parametrize("leaf,fan,radius", [(20, 4, 0.7), (10_000, 4, 1.0), (10, 8, 0.0)])
def test_pairs_within_equal_brute_force(spark, leaf, fan, radius):
    rows = clustered_vectors(3, 400)
    got = {(r.a, r.b): r.d for r in metric.pairs_within(frame(spark, rows), radius, leaf=leaf, fan=fan).collect()}
    v = np.array([x for _, x in rows])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    sure = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if d[a, b] <= radius}
    assert sure <= set(got) and len(got) == len(metric.pairs_within(frame(spark, rows), radius, leaf=leaf, fan=fan).collect())
    assert all(d[a, b] <= radius + 1e-6 and abs(d[a, b] - x) < 1e-6 for (a, b), x in got.items())


def test_crowded_cells_are_cut(spark):
    """Comparisons per row stay level when clustered data grow: cells hold a bounded number of points."""
    per_row = []
    for n in (600, 2400):
        rows = clustered_vectors(5, n, groups=n // 20)
        placed = metric.cells(frame(spark, rows).withColumn("vv", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 0.5, leaf=30, fan=8)
        work = placed.groupBy("cell").agg((F.count_if("home") * F.count("*")).alias("w")).agg(F.sum("w")).first()[0]
        assert placed.filter("home").count() == n
        per_row.append(work / n)
    assert per_row[1] < 2 * per_row[0] and per_row[1] < 0.2 * 2400


def plain_single_link(rows, k):
    v = np.array([x for _, x in rows])
    edges = sorted((round(float(np.sqrt(((v[a] - v[b]) ** 2).sum())), 9), a, b) for a in range(len(v)) for b in range(a + 1, len(v)))
    home = list(range(len(v)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    left = len(v)
    for _, a, b in edges:
        if left <= k:
            break
        x, y = find(a), find(b)
        if x != y:
            home[max(x, y)] = min(x, y)
            left -= 1
    return {rows[i][0]: rows[find(i)][0] for i in range(len(v))}


@pytest.mark.parametrize("k", [8, 480])
def test_single_link_equals_merging_the_nearest(spark, k):
    rows = [(i, [round(x, 3) for x in v]) for i, v in clustered_vectors(9, 500)]
    got = dict(map(tuple, linkage.single_link(frame(spark, rows), k, 1.5).collect()))
    assert got == plain_single_link(rows, k)


def test_single_link_of_few_points(spark):
    assert linkage.single_link(frame(spark, []), 3, 1.0).collect() == []
    assert [tuple(r) for r in linkage.single_link(frame(spark, [(7, [1.0])]), 3, 1.0).collect()] == [(7, 7)]


def plain_average_link(spark, n, weight, similarity, t):
    """The best pair of clusters merges, one at a time."""
    names = spark.range(n).withColumnRenamed("id", "x").crossJoin(spark.range(n).withColumnRenamed("id", "y")).filter("x < y")
    tie = {(r.x, r.y): r.h for r in names.select("x", "y", F.xxhash64("x", "y").alias("h")).collect()}
    members = {i: [i] for i in range(n)}
    while True:
        best = None
        for x in members:
            for y in members:
                if x < y:
                    total = sum(similarity[min(i, j), max(i, j)] * weight[i] * weight[j] for i in members[x] for j in members[y])
                    pairs = sum(weight[i] for i in members[x]) * sum(weight[j] for j in members[y])
                    if total > pairs * round(t * linkage.SCALE):
                        best = max(best or (0, 0, 0, 0), (total / pairs, tie[x, y], x, y))
        if best is None:
            return {i: c for c, ids in members.items() for i in ids}
        members[best[2]] += members.pop(best[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_average_link_equals_merging_the_best_pair(spark, seed):
    rng = random.Random(seed)
    n, t, floor = 30, 0.28, 0.25
    topic = [rng.randrange(6) for _ in range(n)]
    similarity = {}
    for a in range(n):
        for b in range(a + 1, n):
            s = rng.uniform(0.15, 0.75) if topic[a] == topic[b] else rng.uniform(0, 0.3)
            similarity[a, b] = round(round(s, 2) * linkage.SCALE)  # many ties
    weight = [rng.choice([1, 1, 1, 4]) for _ in range(n)]
    every = spark.createDataFrame([(a, b, s) for (a, b), s in similarity.items()], "a bigint, b bigint, s bigint")
    asked = []

    def weights(pairs):
        found = pairs.join(every, ["a", "b"])
        asked.append(found.count())
        return found

    points = spark.createDataFrame(list(enumerate(weight)), "id bigint, n bigint")
    known = every.filter(F.col("s") > round(floor * linkage.SCALE))
    got = dict(map(tuple, linkage.average_link(points, known, t, floor, weights).collect()))
    assert got == plain_average_link(spark, n, weight, similarity, t)
    assert 0 < sum(asked) <= (math.ceil((1 - floor) / (t - floor))) * known.count() and 1 < len(set(got.values())) < n


def test_average_link_of_nothing(spark):
    none = spark.createDataFrame([], "a bigint, b bigint, s bigint")
    points = spark.createDataFrame([(1, 1), (2, 1)], "id bigint, n bigint")
    assert sorted(map(tuple, linkage.average_link(points, none, 0.3, 0.2, lambda p: none).collect())) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        linkage.average_link(points, none, 0.3, 0.3, lambda p: none)


def test_rounds_do_not_add_up_on_disk(spark, monkeypatch):
    """Of the pairs and members of a round only the last are left, however many rounds there are."""
    made, settle = [], linkage.settled

    def noted(df):
        made.append(settle(df))
        return made[-1]

    monkeypatch.setattr(linkage, "settled", noted)
    points = spark.range(16).select("id", F.lit(1).alias("n"))
    # a chain whose links weaken: one merge after the other
    known = spark.createDataFrame([(i, j, round((0.9 - 0.01 * j) * linkage.SCALE)) for i in range(16) for j in range(i + 1, 16)], "a bigint, b bigint, s bigint")
    got = linkage.average_link(points, known, 0.5, 0.4, lambda pairs: pairs.selectExpr("a", "b", "cast(0 as bigint) as s"))
    assert got.select("cluster").distinct().count() == 1

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    assert len(made) > 12 and sum(map(there, made)) <= 4
