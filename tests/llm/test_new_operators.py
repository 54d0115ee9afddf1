"""Conversation trie, filter audit and suffix-tree scores against brute force, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tidewire.llm import suffix_tree as st
from tidewire.llm import turn_trie as tt
from tidewire.llm.audit import op12_filter_interaction_audit

SF = "/root/testdata/sf0.001"

TURNS = (
    [(c, t, r, f"{c // 7} says {t}" if t else "all begin so") for c in range(60) for t, r in enumerate(["system", "user", "assistant", None][: 1 + c % 4])]
    + [(c, t, "user", f"turn {t}") for c in (101, 102, 103, 106) for t in range(30)]
    + [(200, None, "user", None), (200, None, None, "x"), (200, 0, "a", ""), (200, 0, "a", ""), (207, 5, "", None), (None, 1, "user", "lost"),
       (-3, 0, "user", "below zero"), (10**12, 1, "user", "all begin so")]
)


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    nodes, ends, sums = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - int(math.fmod(c, 5))
        built = tuple(own.get(leader, [])[:h] + own[c][h:])
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
        ends[built].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            s = sums.setdefault(n[:d], [0, 0])
            s[0] += n not in children
            s[1] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], *sums[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in nodes.items())


@pytest.mark.parametrize("shard_rows,queue_rows", [(100_000, 100_000), (20, 3), (1, 1)])
def test_trie_equals_the_plain_one(spark, monkeypatch, shard_rows, queue_rows):
    monkeypatch.setattr(tt, "SLICE", 4)
    rows = [(*r, "clash", "clash") for r in TURNS]
    got = tt.trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string, k1 string"), shard_rows, queue_rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_trie(TURNS), key=repr)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tt.op11_conversation_prefix_trie(none).collect() == []
    lost = spark.createDataFrame([(None, 1, "user", "x")], none.schema)
    assert tt.op11_conversation_prefix_trie(lost).collect() == []


def test_queue_gives_back_in_order_what_it_spilled():
    queue = tt.SpillingQueue(3, runs=2)
    items = [((i * 37) % 101, i) for i in range(101)]
    for item in items:
        queue.push(item)
    assert len(queue.heap) <= 3 and len(queue.runs) <= 3
    assert [queue.pop() for _ in items] == sorted(items) and queue.first() is None


def plain_audit(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    cells = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {k for k, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            re.search("[#$%&*|]", text), i is not None and first[text] < i)) if bad}
        marks = [m for m in labels if m[0] is not None and m[0] == i]
        cells[lang or ""].append((failed, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = set()
    for part, rows in cells.items():
        shapley, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                gone = [set(order[: step - 1]) & f != set() for f, _, _ in rows]
                here = [r for r, g in zip(rows, gone) if not g and letter in r[0]]
                shapley[letter] += len(here)
                found.append((part, order, step, len(rows) - sum(gone) - len(here), len(here), sum(g and letter in r[0] for r, g in zip(rows, gone)),
                              sum(r[0] == {letter} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
        out |= {(*f, shapley[f[1][f[2] - 1]]) for f in found}
    return out


def test_audit_equals_the_plain_one(spark):
    words = " ".join(f"w{i}" for i in range(250))
    docs = [(1, words, "en"), (2, words, "en"), (2, words, "de"), (3, words + " # A", None), (4, None, "en"), (5, "", "en"), (6, "A B C", ""), (7, "a " * 300, "en"),
            (8, "B " * 300, "en"), (9, words + " |", "en"), (10, words + " |", "en"), (None, words, "en"), (None, words, "en"), (11, "é ü\x0bx", "fr"),
            (12, "A" * 50_000, "en"), (12, "A" * 50_000, "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (7, 1, 0), (10, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, lang string, mask string, good int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = op12_filter_interaction_audit(frame, marks).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert op12_filter_interaction_audit(frame.limit(0), marks).collect() == []
    assert len(op12_filter_interaction_audit(frame, marks.limit(0)).collect()) == len(want)


class PlainTree:
    """The suffix tree with dictionaries."""

    def __init__(self, texts, held):
        self.docs = [[*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b""] for t in texts]
        self.counts, self.after = Counter(), Counter()
        for words, out in zip(self.docs, held):
            for i in range(len(words) if not out else 0):
                for n in range(min(i, st.MAX_DEPTH) + 1):
                    self.counts[tuple(words[i - n:i + 1])] += 1
                    self.after[tuple(words[i - n:i])] += 1
        self.n, self.v = self.after[()], sum(len(k) == 1 for k in self.counts)
        gain = Counter()
        for words, out in zip(self.docs, held):
            for i in range(len(words) if not out else 0):
                p = self.ladder(words, i, 1)
                for n in range(1, len(p)):
                    gain[tuple(words[i - n:i])] += math.log(p[n] / p[n - 1])
        self.states = {s for s, g in gain.items() if g >= st.DIVERGENCE * self.after[s]}
        self.margin = min((abs(g / self.after[s] - st.DIVERGENCE) for s, g in gain.items()), default=1)

    def ladder(self, words, i, less=0):
        p = [(self.counts[words[i],] + 1 - less) / (self.n - less + self.v + 1)]
        for n in range(1, min(i, st.MAX_DEPTH) + 1):
            s = tuple(words[i - n:i])
            if self.after[s] < st.least_count(self.n):
                break
            p.append((self.counts[*s, words[i]] - less + st.STRENGTH * p[-1]) / (self.after[s] - less + st.STRENGTH))
        return p

    def score(self, words):
        base = best = 0.0
        for i in range(len(words)):
            p = self.ladder(words, i)
            n = max((n for n in range(len(p)) if n == 0 or tuple(words[i - n:i]) in self.states))
            base, best = base + math.log10(p[0]), best + math.log10(p[n])
        return len(words), sum(self.counts[w,] > 0 for w in words), base, best


def documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "ABC abc " * 3000), (1003, "ABC abc " * 3000), (None, "no id at all"), (1004, "x" * 100_000), (1005, "é   Ü")]
    return rows


@pytest.mark.parametrize("limit", [1 << 21, 5000])
def test_scores_equal_the_plain_tree(spark, limit):
    rows = documents(spark)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, block string, row int").repartition(3)
    got = {}
    for r in st.scored(frame, limit=limit).collect():
        got.setdefault(r.doc_id, []).append(r)
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    tree = PlainTree([t or "" for _, t in rows], held)
    assert 0 < len(tree.states) and any(len(s) > 1 for s in tree.states) and sum(map(len, got.values())) == len(rows)
    for (i, _), words, out in zip(rows, tree.docs, held):
        n_tokens, n_known, base, best = tree.score(words)
        r = got[i][-1]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n_tokens, n_known, tree.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(best, rel=1e-3), i
    assert sum(r.score for rs in got.values() for r in rs) > sum(r.base_score for rs in got.values() for r in rs)


def test_distributions_sum_to_one(spark):
    rows = documents(spark)
    tree = PlainTree([t or "" for _, t in rows], [False] * len(rows))
    words = sorted({w for d in tree.docs for w in d})
    for state in sorted(tree.states, key=lambda s: -tree.after[s])[:20]:
        total = sum(tree.ladder([*state, w], len(state))[-1] for w in [*words, b"never seen"])
        assert total == pytest.approx(1)


def test_scores_of_no_rows_and_of_held_out_rows_alone(spark):
    frame = spark.createDataFrame([(i, "some words") for i in range(40)], "doc_id bigint, text string")
    assert st.op13_lm_scoring(frame.limit(0)).collect() == []
    alone = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = st.op13_lm_scoring(frame.filter(frame.doc_id.isin(alone))).collect()
    assert len(got) == len(alone) and all((r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) == (0, 0, 3, 0, 0) for r in got)
