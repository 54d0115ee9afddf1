"""The pipeline against a plain version that holds all documents in memory, and on awkward tables."""

import re
import zlib

import numpy as np
import pytest
from test_copies import first_of_each_component

import corpus_pipeline
from tidewire.llm import pii, quality, tokens
from tidewire.llm.packing import pieces

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pairwise_score(machine, text):
    """The score with every pair of features written out."""
    index, value = machine.row(*quality.features(text, machine.bins))
    v = machine.factors[index] * value[:, None]
    every = v @ v.T
    margin = machine.bias + value @ machine.linear[index] + (every.sum() - np.trace(every)) / 2
    return 1 / (1 + np.exp(-margin))


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def without_benchmark(texts, items):
    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return {i: t for i, t in texts.items() if clean(t)}


def test_run_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.orderBy("doc_id").collect()}
    machine = quality.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {i: t for i, t in texts.items() if pairwise_score(machine, t) >= quality.THRESHOLD}
    first = first_of_each_component(sorted(texts.items()))
    texts = {i: t for i, t in texts.items() if i in first}
    texts = without_benchmark(texts, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    model = pii.train(pii.sample_passages(docs.filter(docs.doc_id.isin(*texts))))
    want = set()
    full = tokens.encoder(ranks=None)
    for i, text in texts.items():
        rules = pii.rule_spans(text)
        ids = [*full(pii.masked(text, rules + pii.added_spans(text, rules, model))), 0]
        at = 0
        while at < len(ids):
            length = min(1024, 1 << ((len(ids) - at).bit_length() - 1))
            want.add((i, at, length, zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes()), len(ids)))
            at += length
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(want) > len(texts) > 0
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.bucket == r.length for r in rows)


ROWS = [(1, "Plain words about the weather in the north. " * 9), (2, "Plain words about the weather in the north. " * 9), (3, ""),
        (4, None), (None, "write to me@a.example.org please, " * 4), (5, "ab" * 20_000), (5, "ab" * 20_000), (6, " \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "hot", None, *["clash"] * 8) for i, t in ROWS],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 + ", ".join(f"{c} string" for c in ("kh", "fp", "ids", "score", "row", "first_id", "quality", "hash")))


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, odd, n):
    name, stage = corpus_pipeline.STAGES[n]
    got = stage(spark, odd, SF)
    assert stage(spark, odd.limit(0), SF).count() == 0
    if n < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == odd.columns
        kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
        given = sorted((str(i), t or "") for i, t in ROWS)
        if name == "simhash near-dedup":  # copies and the three wordless texts leave one row each
            assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "5", "None"]
        elif name == "benchmark decontamination":
            assert kept == given
        elif name == "personal data":
            assert len(kept) == len(given) and not any("@" in t for _, t in kept)
        else:
            assert set(kept) <= set(given)


def test_pieces_of_awkward_and_empty_tables(odd):
    got = pieces(odd).collect()
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert sizes[3] == sizes[4] == 1  # nothing but the closing id
    assert sizes[5] == 2 * next(r.doc_tokens for r in got if r.doc_id == 5) and set(sizes) == {1, 2, 3, 4, 5, 6, None}
    assert pieces(odd.limit(0)).count() == 0
