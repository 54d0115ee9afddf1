"""Personal data: four fixed rules, and a semi-Markov conditional random field that adds what the rules miss.

The field scores whole segments (a run of tokens with a kind) by features of the complete span, so boundaries and kinds
are chosen together by one dynamic programme whose segments have at most ``SPAN_TOKENS`` tokens. It learns from a
bounded sample of passages that the rules have labelled, and from the same passages with the labelled spans rewritten
(no plus sign, spelled-out "at"). A span of the rules always stays; the field adds spans that overlap none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
SAMPLE_PASSAGES = 500
SPAN_TOKENS = 20
REACH = 48

Span = tuple[str, int, int]

# The patterns of the rules. Possessive and anchored where that cannot change a match but avoids rescans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GOES_ON = re.compile(r"[.-][A-Za-z0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKS = re.compile(r"[0-9@]+")
_TRIGGER = re.compile(r"[0-9@]+|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")  # every candidate segment holds one
_SAID = re.compile(r"at\s*[\])]?\s*[A-Za-z0-9-]+?(?:\.|\s?[\[(]?dot[\])]?\s?)[A-Za-z0-9-]", re.I)  # any spelled-out address does
_TOKENS = re.compile(r"(?:[A-Za-z]++|[0-9]++|\s++|[^A-Za-z0-9\s]){0,%d}+" % SPAN_TOKENS)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_AT = re.compile(r"\s?[\[(]?\s?(?:@|\bat\b)\s?[\])]?\s?", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each at sign, the same as scanning for the whole pattern from the left."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1  # no match can reach back over an at sign
        at = text.find("@", free)


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _tokens_before(text: str, at: int) -> int:
    """Where the SPAN_TOKENS tokens before a place begin."""
    width = 128
    while True:
        low = max(0, at - width)
        taken = _TOKENS.match(text[low:at][::-1]).end()
        if low == 0 or taken < at - low:
            return at - taken
        width *= 4


def passages(text: str, trigger: re.Pattern = _TRIGGER, by_token: bool = True) -> list[tuple[int, int]]:
    """Stretches around digits, at signs and the word "at" that hold every candidate segment; all else is outside for certain.

    They reach REACH characters to each side and, with ``by_token``, at least as many tokens as a segment may have.
    """
    out: list[tuple[int, int]] = []
    for m in trigger.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if by_token:
            start, end = min(start, _tokens_before(text, m.start())), max(end, _TOKENS.match(text, m.end()).end())
        while out and start <= out[-1][1]:
            a, b = out.pop()
            start, end = min(start, a), max(end, b)
        out.append((start, end))
    return out


def span_features(text: str, start: int, end: int) -> list[float]:
    """Properties of the whole span and of the characters beside it."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    letters = any(c.isalpha() for c in span)
    parts = span.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    sides = [s.strip() for s in _AT.split(span)]
    mail = len(sides) == 2 and all(sides) and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", sides[0])) and bool(
        re.fullmatch(r"[A-Za-z0-9-]+((\.|\s?[\[(]?dot[\])]?\s?)[A-Za-z0-9-]+)+", sides[1]))
    return [
        1.0, float(n < 8), float(8 <= n <= 9), float(10 <= n <= 15), float(16 <= n <= 19), float(n > 19),
        float(mail), float("@" in span), float(letters), float(len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        float(not letters and 16 <= n <= 19 and luhn("".join(groups))), float(span[0] == "+"), float(span[0] == "("),
        float([len(g) for g in groups[-3:]] == [3, 3, 4]), float(len(groups) == 4 and all(len(g) == 4 for g in groups)),
        float(len(groups) == 1), float(bool(re.search(r"[^0-9\s().+-]", span))), float(before.isalnum()), float(after.isalnum()),
        float(before == "+" or before in "(" and before != ""), float("\n" in span), float(span[-1].isdigit()), float("  " in span),
        float(before in _LOCAL), float(bool(_GOES_ON.match(text, end))),
    ]


FEATURES = 25


class Passage:
    """Tokens, candidate segments and their features; a segment holds seven digits or an "at" and has no blank edge."""

    def __init__(self, text: str):
        self.text = text
        self.cuts = [m.span() for m in _TOKEN.finditer(text)]
        digits = np.r_[0, np.cumsum([b - a if text[a] in "0123456789" else 0 for a, b in self.cuts])]
        ats = np.r_[0, np.cumsum([text[a:b].lower() in ("@", "at") for a, b in self.cuts])]
        edge = [not text[a:b].isspace() for a, b in self.cuts]
        self.segments = [
            (i, j) for i in range(len(self.cuts)) if edge[i]
            for j in range(i + 1, min(len(self.cuts), i + SPAN_TOKENS) + 1)
            if edge[j - 1] and (digits[j] - digits[i] >= 7 or (ats[j] > ats[i] and j - i >= 4))]
        self.features = np.array([span_features(text, self.cuts[i][0], self.cuts[j - 1][1]) for i, j in self.segments]).reshape(-1, FEATURES)
        self.by_end: list[list[int]] = [[] for _ in range(len(self.cuts) + 1)]
        for s, (_, j) in enumerate(self.segments):
            self.by_end[j].append(s)


class SegmentField:
    """Weights per kind and feature, and one per pair of neighbouring labels (kinds, then outside)."""

    def __init__(self) -> None:
        self.weights = np.zeros((FEATURES, len(KINDS)))
        self.weights[0] = -4.0  # without evidence everything is outside
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def silent(self) -> list[bool]:
        """By ``_signs`` of a passage: whether no segment in it can beat the outside, given that none holds a digit, an at sign or an address.

        The features such a segment has for certain count in full, of those that exclude each other the better one, and
        those that need a sign the passage lacks not at all. The neighbouring labels are taken at their best.
        """
        k = len(KINDS)
        before = (self.pairs[:, :k] - self.pairs[:, k:]).max(axis=0)
        after = np.maximum((self.pairs[:k] - self.pairs[k]).max(axis=1), 0)
        longest = max(-3 * self.pairs[k, k], (1 - SPAN_TOKENS) * self.pairs[k, k])
        plain = self.weights[[0, 1, 8, 16]].sum(axis=0) + before + after + longest
        none = np.zeros(k)
        out = []
        for signs in range(8):
            bracket, line, blanks = signs & 1, signs & 2, signs & 4
            best = plain + np.maximum(self.weights[[18, 23, 24]], 0).sum(axis=0)
            best += np.maximum.reduce([none, self.weights[11], self.weights[12]]) if bracket else none
            best += np.maximum.reduce([none, self.weights[17], self.weights[19] if bracket else none])
            best += np.maximum(none, self.weights[20]) if line else none
            best += np.maximum(none, self.weights[22]) if blanks else none
            out.append(bool((best < -1e-6).all()))
        return out

    def forward(self, p: Passage, scores: np.ndarray) -> np.ndarray:
        k = len(KINDS)
        alpha = np.full((len(p.cuts) + 1, k + 1), -np.inf)
        alpha[0, k] = 0.0
        for j in range(1, len(p.cuts) + 1):
            alpha[j, k] = np.logaddexp.reduce(alpha[j - 1] + self.pairs[:, k])
            if p.by_end[j]:
                from_ = np.logaddexp.reduce(alpha[[p.segments[s][0] for s in p.by_end[j]]][:, :, None] + self.pairs[None, :, :k], axis=1)
                alpha[j, :k] = np.logaddexp.reduce(from_ + scores[p.by_end[j]], axis=0)
        return alpha

    def learn(self, p: Passage, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of the gold segments (first token, end token, kind)."""
        k = len(KINDS)
        scores = p.features @ self.weights
        alpha = self.forward(p, scores)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        by_start: list[list[int]] = [[] for _ in range(len(p.cuts) + 1)]
        for s, (i, _) in enumerate(p.segments):
            by_start[i].append(s)
        for i in range(len(p.cuts) - 1, -1, -1):
            ways = [self.pairs[:, k] + beta[i + 1, k]]
            for s in by_start[i]:
                ways.append(np.logaddexp.reduce(self.pairs[:, :k] + scores[s] + beta[p.segments[s][1], :k], axis=1))
            beta[i] = np.logaddexp.reduce(ways, axis=0)
        total = np.logaddexp.reduce(alpha[-1])
        expected = np.zeros_like(self.pairs)
        share = np.zeros_like(scores)
        for i in range(len(p.cuts)):
            expected[:, k] += np.exp(alpha[i] + self.pairs[:, k] + beta[i + 1, k] - total)
        for s, (i, j) in enumerate(p.segments):
            both = np.exp(alpha[i][:, None] + self.pairs[:, :k] + scores[s] + beta[j, :k] - total)
            expected[:, :k] += both
            share[s] = both.sum(axis=0)
        seen, wanted, ends = np.zeros_like(self.pairs), np.zeros_like(scores), {i: (j, kind) for i, j, kind in gold}
        at, last = 0, k
        place = {segment: s for s, segment in enumerate(p.segments)}
        while at < len(p.cuts):
            j, kind = ends.get(at, (at + 1, k))
            seen[last, kind] += 1
            if kind < k:
                wanted[place[at, j], kind] = 1
            at, last = j, kind
        self.weights += rate * (p.features.T @ (wanted - share))
        self.pairs += rate * (seen - expected) * 0.1

    def best(self, p: Passage) -> list[tuple[int, int, int]]:
        """Segments of the most likely segmentation: (first token, end token, kind)."""
        k = len(KINDS)
        if not p.segments:
            return []
        scores = p.features @ self.weights
        top = np.full((len(p.cuts) + 1, k + 1), -np.inf)
        top[0, k] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, len(p.cuts) + 1):
            ways = top[j - 1] + self.pairs[:, k]
            back[j, k] = (j - 1, int(ways.argmax()))
            top[j, k] = ways.max()
            for s in p.by_end[j]:
                i = p.segments[s][0]
                ways = top[i][:, None] + self.pairs[:, :k] + scores[s]
                for kind in np.flatnonzero(ways.max(axis=0) > top[j, :k]):
                    top[j, kind] = ways[:, kind].max()
                    back[j, int(kind)] = (i, int(ways[:, kind].argmax()))
        found, at, label = [], len(p.cuts), int(top[-1].argmax())
        while at > 0:
            i, before = back[at, label]
            if label < k:
                found.append((i, at, label))
            at, label = i, before
        return found[::-1]


def _gold(p: Passage, spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """Spans as token segments; None if one does not lie on token borders or is no candidate."""
    starts, ends = {a: i for i, (a, _) in enumerate(p.cuts)}, {b: i + 1 for i, (_, b) in enumerate(p.cuts)}
    known, out, free = set(p.segments), [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[1] - s[2])):
        if a < free:
            continue  # the longer of two overlapping spans stands
        if a not in starts or b not in ends or (starts[a], ends[b]) not in known:
            return None
        out.append((starts[a], ends[b], KINDS.index(kind)))
        free = b
    return out


def _rewrites(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The passage itself, and one rewritten form for each phone number and address in it."""
    yield text, spans
    for kind, a, b in spans:
        said = text[a:b]
        forms = []
        if kind == "phone":
            forms = [re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", said)]
        elif kind == "email":
            forms = [said.replace("@", " at "), said.replace("@", " [at] ")]
        for form in forms:
            if len(spans) == 1 and len(re.sub("[^0-9]", "", form)) >= 7 or kind == "email" and len(spans) == 1:
                yield text[:a] + form + text[b:], [(kind, a, a + len(form))]


def train(samples: list[str], epochs: int = 6, rate: float = 0.3) -> SegmentField:
    """Fit on passages labelled by the rules. Without samples the field finds nothing."""
    model = SegmentField()
    cases = []
    for text in samples:
        for form, spans in _rewrites(text, rule_spans(text)):
            p = Passage(form)
            if p.segments and (gold := _gold(p, spans)) is not None:
                cases.append((p, gold))
    for epoch in range(epochs):
        for p, gold in cases:
            model.learn(p, gold, rate / (1 + epoch))
    return model


def _signs(part: str) -> int:
    return ("(" in part or "+" in part) | ("\n" in part) << 1 | ("  " in part) << 2


def added_spans(text: str, base: list[Span], model: SegmentField, silent: list[bool] | None = None) -> list[Span]:
    """Segments of the most likely segmentation that overlap no span of the rules. ``silent`` spares working out the model's anew."""
    out = []
    silent = model.silent() if silent is None else silent
    for start, end in passages(text):
        part = text[start:end]
        if silent[_signs(part)] and not _MARKS.search(part) and not _SAID.search(part):
            continue  # its best segmentation is all outside
        p = Passage(part)
        for i, j, kind in model.best(p):
            a, b = start + p.cuts[i][0], start + p.cuts[j - 1][1]
            if not any(x < b and a < y for _, x, y in base):
                out.append((KINDS[kind], a, b))
    return out


def sample_passages(docs: DataFrame, limit: int = SAMPLE_PASSAGES) -> list[str]:
    """At most ``limit`` passages of up to 400 characters, lowest hashes first: half with rule spans, a quarter with digits or
    at signs alone, a quarter with nothing but the word "at"."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0):
                text = value.as_py()
                for trigger in (_MARKS, _TRIGGER):
                    for a, b in passages(text, trigger, by_token=False):
                        part = text[a:b]
                        plain = not _MARKS.search(part)
                        if b - a <= 400 and plain == (trigger is _TRIGGER):
                            found.append((part, 2 if plain else 0 if rule_spans(part) else 1))
            yield pa.record_batch([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["passage", "kind"])

    cuts = docs.select(whole().alias("text")).mapInArrow(cut, "passage string, kind int")
    chosen = None
    for kind, share in enumerate((2, 4, 4)):
        part = cuts.filter(F.col("kind") == kind).select("passage", F.xxhash64("passage").alias("h")).groupBy("h").agg(
            F.min("passage").alias("passage")).orderBy("h").limit(max(1, limit // share))
        chosen = part if chosen is None else chosen.unionByName(part)
    return sorted(r.passage for r in chosen.collect())  # bounded by ``limit``


def private_spans(docs: DataFrame, columns: list[str], model: SegmentField) -> DataFrame:
    """``columns`` of every document with ``base`` and ``spans``: arrays of (kind, start, end) in code points.

    Null and empty texts have no spans. Repeated rows each get the same result. Columns named base or spans may not be
    asked for; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    source = docs.select(*columns, whole().alias("pii_text"))
    out = source.drop("pii_text").schema
    for name in ("base", "spans"):
        out = out.add(name, T.ArrayType(T.StructType.fromDDL("kind string, start bigint, end bigint")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        silent = m.silent()
        for batch in batches:
            base, every = [], []
            for value in batch.column(len(columns)):
                text = value.as_py()
                rules = rule_spans(text)
                more = added_spans(text, rules, m, silent)
                merged = sorted(rules + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                base.append([dict(zip(("kind", "start", "end"), s)) for s in rules])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in merged])
            yield pa.record_batch([*batch.columns[:-1], pa.array(base, kind), pa.array(every, kind)], names=[*columns, "base", "spans"])

    return source.mapInArrow(of, out)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one of the first kind."""
    out, free = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"<{kind}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def masked_documents(docs: DataFrame, model: SegmentField) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, and n_chars, where there is one, counted anew; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        silent = shared.value.silent()
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py()
                if text is not None:
                    rules = rule_spans(text)
                    text = masked(text, rules + added_spans(text, rules, shared.value, silent))
                out.append(text)
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    out = docs.mapInArrow(of, schema)
    return out.withColumn("n_chars", F.char_length(whole()).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_pii(docs: DataFrame) -> DataFrame:
    rows = private_spans(docs, ["doc_id"], train(sample_passages(docs)))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(counted, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
