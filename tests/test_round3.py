"""Cases found on odd inputs and larger tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates

AS_OF = datetime(2024, 1, 30, 12)


@pytest.mark.parametrize("before,want", [(3600.5, "fresh"), (3600, "very_fresh"), (3599.5, "very_fresh"), (259200.000001, "archive"), (-0.5, "very_fresh")])
def test_freshness_counts_whole_seconds_of_both_times(spark, before, want):
    df = spark.createDataFrame([(AS_OF - timedelta(seconds=before),)], "p timestamp_ntz")
    assert df.select(dates.freshness_class(F.col("p"), AS_OF).alias("y")).first().y == want


def test_span_counts_whole_seconds_of_both_times(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, 900_000), datetime(2024, 1, 2, 0, 0, 0, 100_000))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(dates.span_label(F.col("a"), F.col("b")).alias("y")).first().y == "1 days"


def test_rows_alike_in_time_and_url_are_taken_by_the_tie_columns(spark):
    from tidewire.sources import feeds

    rows = spark.createDataFrame([(i, "u", AS_OF) for i in range(400)], "id bigint, url string, published_at timestamp_ntz")
    for seed in (1, 2, 3):
        got = feeds.discover({"a": rows.repartition(7).orderBy(F.rand(seed))}, 5, ["id"]).select("id").collect()
        assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]


def test_names_meet_a_long_list_of_keys(spark):
    """The list was refused beyond 4 MB, and every name met every key."""
    from tidewire.operators import geo

    listed = spark.range(120_000).select(F.concat(F.lit("key number "), "id", F.lit(" of a long list of names")).alias("key"), F.col("id").cast("string").alias("canonical"))
    known = listed.union(spark.createDataFrame([("Blue", "b"), ("blue SKY", "s"), ("blue", "other"), ("tie1", "t1"), ("tie0", "t0")], "key string, canonical string"))
    names = spark.createDataFrame([("a blue sky over",), ("BLUE",), ("tie0 tie1",), ("key number 77 of",), ("nothing",), (None,)], "name string")
    got = {r.name: r.canonical for r in geo.canonical_names(names, "name", known).collect()}
    assert got == {"a blue sky over": "s", "BLUE": "b", "tie0 tie1": "t0", "key number 77 of": "77", "nothing": None, None: None}
    assert geo.canonical_names(names, "name", known).count() == 6


@pytest.mark.parametrize("cosine,t", [(True, 0.55), (True, 0.2), (False, 0.3), (False, 0.85)])
def test_block_join_equals_brute_force_and_holds_no_candidates(spark, monkeypatch, cosine, t):
    """What leaves the join is what reaches the threshold; frequent terms made billions of partial products."""
    import random

    from tidewire.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 300)
    rng, rows = random.Random(9), []
    for i in range(200):
        terms = sorted({int(rng.random() ** 2 * 60) for _ in range(rng.randint(0, 15))} | ({0, 1, 2, 3, 4} if i % 5 == 0 else set()))
        raw = [float(rng.randint(1, 9)) if cosine else 1.0 for _ in terms]
        z = sum(w * w for w in raw) ** 0.5 if cosine else 1.0
        rows.append((f"r{i}", terms, [w / z for w in raw]))
    df = spark.createDataFrame(rows, "id string, codes array<bigint>, weights array<double>").repartition(5)
    got = {(min(r.a, r.b), max(r.a, r.b)): round(r.similarity, 9) for r in blocks.similar(df, t, cosine).collect()}
    assert len(got) == blocks.similar(df, t, cosine).count()

    def value(x, y):
        shared = sum(w * dict(zip(*y)).get(c, 0.0) for c, w in zip(*x))
        return shared if cosine else shared / max(len(x[0]) + len(y[0]) - shared, 1)

    want = {}
    for i, (a, *x) in enumerate(rows):
        for b, *y in rows[:i]:
            if x[0] and y[0] and value(x, y) >= t - 1e-9:
                want[(min(a, b), max(a, b))] = round(value(x, y), 9)
    assert got == want and want
    if not cosine:
        odd = F.substring("id", 2, 9).cast("int") % 2 == 1
        got = {(r.a, r.b): round(r.similarity, 9) for r in blocks.between(df.filter(odd), df.filter(~odd), t).collect()}
        pairs = {(a, b): s for p, s in want.items() for a, b in (p, p[::-1])}
        assert got == {(a, b): s for (a, b), s in pairs.items() if int(a[1:]) % 2 == 1 and int(b[1:]) % 2 == 0}


def test_long_sets_make_no_candidates(spark, monkeypatch):
    """Pairs of long sets came from signatures, and each candidate carried both sets."""
    from tidewire.operators import simjoin

    def refuse(*_):
        raise AssertionError("candidates of long sets")

    monkeypatch.setattr(simjoin, "verify", refuse)
    rows = [(i, [f"w{j}" for j in range(i % 3, 40)] + [f"x{i}"]) for i in range(12)]
    got = {(r.id_a, r.id_b) for r in simjoin.jaccard_pairs(spark.createDataFrame(rows, "id bigint, w array<string>"), "id", "w", 0.9).collect()}
    assert got == {(i, j) for i in range(12) for j in range(i + 1, 12) if abs(i % 3 - j % 3) <= 2 and
                   len(set(rows[i][1]) & set(rows[j][1])) / len(set(rows[i][1]) | set(rows[j][1])) >= 0.9}


@pytest.mark.parametrize("scope", [None, "c"])
def test_leaders_of_long_sets_equal_the_pass_with_and_without_a_scope(spark, monkeypatch, scope):
    """No candidate of the signatures is written out, chains of followers are settled, and scopes stay apart."""
    import random

    from tidewire.operators import blocks, graph, simjoin

    def refuse(*_):
        raise AssertionError("candidates of long sets")

    monkeypatch.setattr(simjoin, "verify", refuse)
    monkeypatch.setattr(blocks, "BLOCK", 400)
    rng, rows = random.Random(3), []
    for i in range(150):
        c, at = i % 3, rng.randrange(40)
        rows.append((i, c, [f"{c if scope else 0}-{k}" for k in range(at, at + 12)]))
    df = spark.createDataFrame(rows, "id bigint, c int, w array<string>")
    got = {r.id: r.leader for r in graph.set_leaders(df, "id", "w", 0.6, scope=scope).collect()}
    leaders, want = [], {}
    for i, _, w in rows:
        want[i] = next((j for j, v in leaders if len(set(w) & set(v)) / len(set(w) | set(v)) >= 0.6 - 1e-9), i)
        if want[i] == i:
            leaders.append((i, w))
    assert got == want


def test_grams_are_not_cut_out_by_position(spark):
    """A substring by position counts from the start of the text, so a long text took time with its square."""
    from tidewire.operators import search

    assert "substring" not in str(search.grams(F.col("x")))
    texts = ["é𝔸b" * 20 + "end", "ab", "", "Ça"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string")
    got = {r.id: sorted(r.g) for r in df.select("id", search.grams(F.col("x")).alias("g")).collect()}
    assert got == {i: sorted({x.lower()[k:k + 3] for k in range(max(len(x) - 2, 1))}) for i, x in enumerate(texts)}
