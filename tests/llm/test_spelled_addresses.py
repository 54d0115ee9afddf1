"""Spelled-out addresses in texts without a digit or an at sign."""

import re

import numpy as np
import pytest

from tidewire.llm import pii

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.sample_passages(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize("text,said", [
    ("please write to jane at example.org before noon", "jane at example.org"), ("or bob.hill [at] mail.example.com for help", "bob.hill [at] mail.example.com")])
def test_spelled_addresses_are_found_and_masked(spark, model, text, said):
    assert [(kind, text[a:b]) for kind, a, b in pii.added_spans(text, [], model)] == [("email", said)]
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint")
    assert pii.masked_documents(docs, model).first().text == text.replace(said, "<email>")
    [row] = pii.private_spans(docs, ["doc_id"], model).collect()
    assert [(s.kind, text[s.start:s.end]) for s in row.spans] == [("email", said)] and row.base == []


def test_passages_hold_every_candidate_segment_and_skip_none_that_wins(model):
    rng = np.random.default_rng(3)
    parts = ["at", "AT", "(at)", "jane", "dot", "example.org", ".", "-", " ", "  ", "\n", "word", "x" * 60, "é", "٣", "2024", "@", "flat", "+"]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.integers(1, 120)))
        held = pii.passages(text)
        whole = pii.Passage(text)
        for i, j in whole.segments:
            a, b = whole.cuts[i][0], whole.cuts[j - 1][1]
            assert any(x <= a and b <= y for x, y in held)
        scored = []
        for x, y in held:
            p = pii.Passage(text[x:y])
            scored += [(pii.KINDS[k], x + p.cuts[i][0], x + p.cuts[j - 1][1]) for i, j, k in model.best(p)]
        assert pii.added_spans(text, [], model) == scored


@pytest.mark.parametrize("seed", range(6))
def test_skipping_equals_the_full_programme_for_any_weights(seed):
    rng = np.random.default_rng(seed)
    field = pii.SegmentField()
    field.weights += rng.normal(0, 1.5, field.weights.shape)
    field.weights[0] -= rng.choice([0, 2, 5])
    field.pairs += rng.normal(0, 0.4, field.pairs.shape)
    parts = ["at", "(at)", "jane", "dot", "example.org", ".", "-", " ", "  ", "\n", "word", "é", "+", "(", "look at", "2024", "@"]
    for _ in range(40):
        text = "".join(rng.choice(parts[:13 if rng.random() < 0.6 else None]) + rng.choice(["", " "]) for _ in range(rng.integers(1, 90)))
        full = []
        for x, y in pii.passages(text):
            p = pii.Passage(text[x:y])
            full += [(pii.KINDS[k], x + p.cuts[i][0], x + p.cuts[j - 1][1]) for i, j, k in field.best(p)]
        assert pii.added_spans(text, [], field) == full


def segmentations(p, at=0):
    """Every way to cut a passage into segments with a kind and single tokens outside."""
    if at == len(p.cuts):
        yield []
        return
    for rest in segmentations(p, at + 1):
        yield [(at, at + 1, len(pii.KINDS)), *rest]
    for i, j in p.segments:
        if i == at:
            for rest in segmentations(p, j):
                for kind in range(len(pii.KINDS)):
                    yield [(i, j, kind), *rest]


@pytest.mark.parametrize("text", ["call 5551234567", "a at b.c", "1234567 at x.y", "x@y.z 12"])
def test_the_programme_finds_the_best_of_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    p = pii.Passage(text)
    for _ in range(20):
        field = pii.SegmentField()
        field.weights[:] = rng.normal(0, 1, field.weights.shape)
        field.pairs[:] = rng.normal(0, 1, field.pairs.shape)
        scores = p.features @ field.weights
        place = {segment: s for s, segment in enumerate(p.segments)}

        def value(cut):
            total, last = 0.0, len(pii.KINDS)
            for i, j, kind in cut:
                total += field.pairs[last, kind] + (scores[place[i, j], kind] if kind < len(pii.KINDS) else 0)
                last = kind
            return total

        best = max(segmentations(p), key=value)
        assert [c for c in best if c[2] < len(pii.KINDS)] == field.best(p)


def plain_spans(text):
    """The fixed patterns as they are stated, matched from the left."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(reversed(digits))) if digits else 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_rules_equal_the_plain_patterns():
    rng = np.random.default_rng(11)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (509) 555-6973", "+44.20.7946.0958", "+12", "10.0.0.1", "256.1.1.1", "1.2.3",
             " ", "-", ".", "+", "(", ")", "7", "a@b.co", "@", "x.y", "\n", "é", "٣"]
    seen = set()
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.integers(1, 12)))
        want = plain_spans(text)
        seen |= {w[0] for w in want}
        assert pii.rule_spans(text) == want, text
    assert seen == set(pii.KINDS)
    assert pii.rule_spans("0" * 401 + "1.2.3.4") == [("ip", 0, 408)] and pii.rule_spans("0" * 400 + "256.2.3.4") == []


def test_documents_without_a_count_of_characters_are_masked(spark, model):
    docs = spark.createDataFrame([(1, "to a.b@c.example.org"), (2, None)], "doc_id bigint, text string")
    assert [r.text for r in pii.masked_documents(docs, model).orderBy("doc_id").collect()] == ["to <email>", None]
