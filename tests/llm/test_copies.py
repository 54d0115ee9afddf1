"""The near-duplicate stage against brute-force Jaccard over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidewire.llm import copies, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def first_of_each_component(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    home = {i: i for i, _ in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if alike(a, b):
                x, y = find(i), find(j)
                home[max(x, y)] = min(x, y)
    return {i for i in home if find(i) == i}


def edited_rows(seed):
    """Texts with one to four words changed at each step of a chain, a large group of near copies, and a common passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(40):
        words = [word() for _ in range(rng.randint(4, 160))]
        if rng.random() < 0.5:
            words += common.split()
        for _ in range(rng.randint(1, 6)):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = word()
    mass = [word() for _ in range(120)]
    for _ in range(60):
        other = list(mass)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other))] = word()
        rows.append(" ".join(other))
    rows += ["", None, " \t", "one two", "One  two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_keeps_the_first_of_each_jaccard_component(spark):
    rows = edited_rows(5)
    far = [(a, b) for n, (_, a) in enumerate(rows) for _, b in rows[:n]
           if a and b and alike(shingle_set(a), shingle_set(b))
           and (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > simhash.RADIUS]
    assert len(far) > 100  # links out of the radius of the index
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    want = first_of_each_component(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 0.6 * len(rows)


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders = {}, {}
    for r in docs.collect():
        sets[r.doc_id] = shingle_set(r.text)
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    pairs = {(a, b) for ids in holders.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    pairs = {(a, b) for a, b in pairs if alike(sets[a], sets[b])}
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert pairs and not any(a in kept and b in kept for a, b in pairs)
    assert kept >= sets.keys() - {b for _, b in pairs}


def test_shingles():
    assert len(copies.shingles("")) == 0 and len(copies.shingles("A b")) == 1
    assert set(copies.shingles("a b c d e f")) == set(copies.shingles("A B C d e")) | set(copies.shingles("b c d e f"))


@pytest.mark.parametrize("calm", [0, 3])
def test_crowded_signatures_give_the_same_components(spark, monkeypatch, calm):
    monkeypatch.setattr(copies, "HEADS", 1)
    monkeypatch.setattr(copies, "TURNS", 1)
    longer, given = [], copies.longer_signatures
    monkeypatch.setattr(copies, "longer_signatures", lambda *a: longer.append(a[3]) or given(*a))
    rows = edited_rows(8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = copies.near_components(docs, calm=calm)
    first = {r.root: r.first for r in found.groupBy("root").agg({"doc_id": "min"}).toDF("root", "first").collect()}
    assert set(first.values()) == first_of_each_component(rows) and 2 in longer


def test_parities_bound_the_difference():
    rng = random.Random(3)
    for size in (1, 5, 60, 400):
        a = copies.shingles(" ".join(str(rng.random()) for _ in range(size)))
        b = np.unique(np.concatenate([a[size // 3:], copies.shingles(" ".join(str(rng.random()) for _ in range(size // 4)))]))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(copies.parities(a).view(np.uint64), copies.parities(b).view(np.uint64)))
        assert apart <= len(np.setxor1d(a, b)) and (copies.parities(a) == copies.parities(a[::-1])).all()
