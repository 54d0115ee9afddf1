"""Operators of the training-data package against brute force, and on awkward tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidewire.llm import edits, pii, sharding, simhash, suffixes, tokens
from tidewire.llm import fingerprints as fp
from tidewire.llm.decontamination import op8_benchmark_decontamination
from tidewire.llm.licences import licence_regions, notices, op2_license_scans
from tidewire.llm.packing import binary_lengths, op3_packing, pieces
from tidewire.llm.queries import QUERIES
from tidewire.llm.quality import op10_quality_classifier

SF = "/root/testdata/sf0.001"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon. " * 3
ROWS = [
    (1, PROSE, "en", "hot", None), (2, PROSE, "en", "hot", 5), (3, "", "en", None, 0), (4, None, None, "hot", None),
    (5, "one", "en", "hot", 3), (6, PROSE[:200] + " Released under the MIT License. " + PROSE[100:], "en", "hot", 9),
    (7, "mail a.b@c.example.com or +1 (509) 555-6973 from 10.0.0.1 card 4111 1111 1111 1111", "en", "hot", 1),
    (8, "x" * 30_000 + " " + "word " * 3_000, "en", "hot", 1), (9, "  \n\t ", "en", "hot", 5), (None, "no id at all here", "en", "hot", 1),
    (10, "repeated row of a few words", "en", "hot", 1), (10, "repeated row of a few words", "en", "hot", 1),
]
NAMES = ("doc_id", "text", "lang", "source", "n_chars", "score", "shard", "at", "hash")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash", "clash", "clash", "clash") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 "score string, shard string, at string, hash string")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PROSE[:120]), (2, "no id at all"), (3, None), (4, ""), (None, "one")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1, 11)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in sorted(rows)}


ONE_ROW_EACH = [
    (fp.op1_fingerprints, ()), (op2_license_scans, ()), (suffixes.op4_suffix_array_dedup, ()), (pii.op5_pii, ()),
    (sharding.op6_sharding, ()), (edits.op7_token_counts, ()), (op8_benchmark_decontamination, ("items",)),
    (simhash.op9_simhash_near_dedup, ()), (op10_quality_classifier, ("labels",)),
]


@pytest.mark.parametrize("operator,more", ONE_ROW_EACH, ids=[o.__name__ for o, _ in ONE_ROW_EACH])
def test_awkward_rows_and_empty_tables(request, odd, operator, more):
    others = [request.getfixturevalue(m) for m in more]
    got = operator(odd, *others).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    twins = [r for r in got if r.doc_id == 10]
    assert twins[0].asDict() == twins[1].asDict() or operator is sharding.op6_sharding
    empty = odd.limit(0)
    assert operator(empty, *others).collect() == []
    assert operator(odd, *(o.limit(0) for o in others)).count() == len(ROWS)


def test_licence_stretches_do_not_depend_on_the_block(spark):
    said = "Released under the MIT License. "
    rows = [(i, "word " * i + said + "word " * (29 - i)) for i in range(30)] + [(30, said * 200), (31, "released under"), (32, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def found(block):
        got = licence_regions(docs, notices(spark), block=block).filter("licence is not null")
        return sorted((r.doc_id, r.licence, r.start, r.dice) for r in got.distinct().collect())

    one = found(1 << 20)
    assert {(i, "MIT", i, 1.0) for i in range(30)} <= set(one)
    assert sum(r[0] == 30 and r[1] == "MIT" and r[3] == 1.0 for r in one) == 200
    assert found(1) == found(7) == found(16) == one


def test_fingerprints(spark, texts):
    ids = list(texts)
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, SF).collect()}
    assert len(got) == len(ids)
    near = []
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, other = texts[i], texts[following]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + other[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(t):
            w = t.lower().split()
            return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}

        a, b = shingles(text), shingles(edited)
        near.append(abs(len(a & b) / len(a | b) - got[i].near_edited))
    assert max(near) < 0.2 and np.mean(near) < 0.03


def test_sketches_merge(spark, odd):
    parts = odd.select("lang", fp.sketch(fp.whole()).alias("sketch"))
    merged = {r.lang: r.sketch for r in fp.merged_sketches(parts, ["lang"]).collect()}
    hashes = {h for r in parts.filter("lang = 'en'").collect() for h in r.sketch}
    assert merged["en"] == sorted(hashes)[:fp.K] and merged[None] == []


def test_packing_round_trip(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = tokens.encoder(ranks=None)
    got = {}
    for r in pieces(docs).collect():
        got.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for i, text in texts.items():
        assert [t for _, part in sorted(got[i].items()) for t in part] == [*full(text), 0]
        assert all(len(p) & (len(p) - 1) == 0 and len(p) <= 1024 for p in got[i].values())
    digest = op3_packing(docs).collect()
    assert len({r.sequence_id for r in digest}) == len(digest)
    assert all(r.ids_crc32 == zlib.crc32(np.array(got[r.doc_id][r.start], "<u4").tobytes()) for r in digest)
    for length in {r.bucket for r in digest}:
        rows = sorted(r.bucket_row for r in digest if r.bucket == length)
        assert rows == list(range(len(rows)))
    assert binary_lengths(1) == [1] and binary_lengths(3000) == [1024, 1024, 512, 256, 128, 32, 16, 8]


def brute_removed(texts):
    seen, out = set(), {}
    for i, text in texts.items():
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(raw[p:p + 100])
        out[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("shard_runs", [3, 50_000])
def test_repeated_bytes(spark, texts, shard_runs):
    got = suffixes.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"), shard_runs).collect()
    assert {r.doc_id: (sum(s.end - s.start for s in r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == brute_removed(texts)


def test_overlapping_repeats(spark):
    rows = [(1, "ab" * 400), (2, "z" * 99), (3, "z" * 100), (4, "z" * 101), (5, "é" * 60 + "ab" * 60)]
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (sum(s.end - s.start for s in r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == brute_removed(dict(rows))


def test_suffix_array():
    for raw in (b"mississippi", b"a" * 200, bytes(np.random.default_rng(1).integers(97, 99, 600).astype("u1"))):
        assert suffixes.suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_rules_equal_plain_patterns(texts):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for text in [*texts.values(), "a@b@c.de x@y.z.w@q.r 1.2.3.4.5.6.7.8 999.1.1.1 @a.b a@-.-"]:
        got = pii.rule_spans(text)
        assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in email.finditer(text)]
        want = [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in got if s[0] == "ip"] == want


def test_field_adds_what_the_rules_miss(spark):
    model = pii.train(pii.sample_passages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    for text, kind in (("ring (509) 555-6973 today", "phone"), ("to bob.24 at mail4.example.com please", "email")):
        assert [s[0] for s in pii.added_spans(text, pii.rule_spans(text), model)] == [kind]
    for text in ("in 2024 we sold 48878564 units", 'token = "4efe2d42c16b845d5c2e16d71d7cc67296c995e8"', "plain words"):
        assert pii.added_spans(text, pii.rule_spans(text), model) == []
    assert pii.masked("a b@c.de f", [("email", 2, 8)]) == "a <email> f"


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    got = sharding.op6_sharding(spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text")).toPandas()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {24} and abs(len(moved) - 240) < 80
    assert got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))).all() and got.shard.nunique() == 24


def test_counts_after_edits(texts):
    counter, full, rng = edits.Counter(), tokens.encoder(ranks=None), np.random.default_rng(5)
    for text in [*list(texts.values())[:60], "", "  \n\n x ", "it's  we'll\n\n\nx" * 50, " " * 300 + "b", "日本語" * 90, "<|endoftext|> hi"]:
        tree = edits.TokenTree(text, counter)
        for _ in range(5):
            a = int(rng.integers(0, len(text) + 1))
            b, new = a + int(rng.choice([0, 1, 7, 90])), str(rng.choice(["", " ", "\n", "'s", " word", "a b  c "]))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text, tree.count) == (text, len(full(text)))


def test_simhash_components(spark, texts):
    def of(text):
        w = text.encode().lower().split()
        runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: of(t) for i, t in texts.items()}
    home = {i: i for i in want}
    for _ in want:
        before = dict(home)
        for i in want:
            home[i] = min(home[j] for j in want if (want[i] ^ want[j]).bit_count() <= 3)
        if home == before:
            break
    got = QUERIES["op9_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{want[i]:016x}", home[i]) for i in want}


def test_gray_index_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 2))) for _ in range(30)]))
    index = simhash.GrayIndex(codes, np.zeros(len(codes), np.int64))
    got = {tuple(sorted((int(index.codes[a]), int(index.codes[b])))) for x, y in index.links(3) for a, b in zip(x, y)}
    want = {tuple(sorted((int(a), int(b)))) for a in codes for b in codes if a < b and (int(a) ^ int(b)).bit_count() <= 3}
    assert got == want
    frame = spark.createDataFrame([(int(np.int64(c)),) for c in codes.view(np.int64)], "fp bigint")
    split = {(r.a, r.b) for r in simhash.near_edges(frame, group_limit=20).collect()}  # hot groups are dealt again
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 64 for a, b in split) and split


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scores = QUERIES["op10_quality_classifier"](spark, folder).toPandas()
    rows = scores.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    rows = rows[rows.held_out]
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(scores.doc_id, scores.held_out))


def test_pipeline_stages(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(path := f"{tmp_path}/{len(sizes)}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    assert all(not pii.rule_spans(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
