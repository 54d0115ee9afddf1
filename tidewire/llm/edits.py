"""Edit-aware token counts: each text keeps a tree of pre-token sums, and an edit re-encodes only what it touches.

Leaves hold ``LEAF`` pre-tokens; an inner node holds the characters and tokens below it. An edit goes down by character
sums to the leaves it touches, takes one leaf more on the left, and splits the changed stretch anew until a border of
the new split falls on a border of the old one beyond the edit. From there on old leaves stay, and sums are updated on
the way to the root. Splits depend on at most one character beyond a pre-token, which the extra leaf covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import tokens
from tidewire.llm.common import whole

LEAF = 64
CACHE = 400_000
_SPLIT = regex.compile(public_tokenizers.PATTERN)
EDITS = "array<struct<start: bigint, end: bigint, replacement: string>>"


class Counter:
    """Tokens of pre-tokens, remembered up to ``CACHE`` of them."""

    def __init__(self, path: str = tokens.TOKENIZER_FILE, ranks: str | None = tokens.RANK_FILE):
        self.encode = tokens.encoder(path, ranks)
        self.known: dict[str, int] = {}

    def pieces(self, text: str, plain: bool | None = None) -> list[tuple[int, int]]:
        """(characters, tokens) of each pre-token. A text on which splitters may differ is one piece; ``plain`` if that is known."""
        if not (tokens.plain(text) if plain is None else plain):
            return [(len(text), len(self.encode(text)))] if text else []
        out, known = [], self.known
        for piece in _SPLIT.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= CACHE:
                    known.clear()
                n = known[piece] = len(self.encode(piece))
            out.append((len(piece), n))
        return out


class TokenTree:
    """Leaves are lists of (characters, tokens); ``levels[0]`` has their sums, each further level sums pairs below it."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.reencoded = text, counter, 0
        self.plain = tokens.plain(text)
        pieces = counter.pieces(text, self.plain)
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)]
        self._grow()

    def _grow(self) -> None:
        self.levels = [[(sum(c for c, _ in leaf), sum(t for _, t in leaf)) for leaf in self.leaves]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._pair(below, i) for i in range(0, len(below), 2)])

    @staticmethod
    def _pair(below: list[tuple[int, int]], i: int) -> tuple[int, int]:
        right = below[i + 1] if i + 1 < len(below) else (0, 0)
        return below[i][0] + right[0], below[i][1] + right[1]

    @property
    def count(self) -> int:
        return self.levels[-1][0][1] if self.leaves else 0

    def leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf that holds the character, its first character) by descent from the root."""
        node, first = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if char >= first + level[node][0] and node + 1 < len(level):
                first += level[node][0]
                node += 1
        return node, first

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]; positions outside the text are moved to its ends."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        new = self.text[:start] + replacement + self.text[end:]
        if not self.leaves or not self.plain or not tokens.plain(replacement) or not tokens.plain(
                new[max(0, start - 500):start + len(replacement) + 500]):
            again = TokenTree(new, self.counter)  # no safe borders: count afresh
            self.__dict__ |= again.__dict__ | {"reencoded": self.reencoded + len(new)}
            return
        low, first = self.leaf_at(start)
        if low > 0:
            low -= 1
            first -= self.levels[0][low][0]
        high, high_first = self.leaf_at(end)
        shift = len(new) - len(self.text)
        border = high_first
        while True:
            border += self.levels[0][high][0]
            pieces = self.counter.pieces(new[first:border + shift])
            self.reencoded += border + shift - first
            keep = self._meet(pieces, first, high, border, end, shift)
            if keep is not None:
                break
            high += 1
        pieces, rest = keep
        if rest is None:
            rest = []
        changed = pieces + rest
        fresh = [changed[i:i + LEAF] for i in range(0, len(changed), LEAF)]
        same = len(fresh) == high + 1 - low
        self.leaves[low:high + 1] = fresh
        self.text = new
        if not same:
            self._grow()  # sums only; nothing is encoded
            return
        for at in range(low, high + 1):
            leaf = self.leaves[at]
            self.levels[0][at] = (sum(c for c, _ in leaf), sum(t for _, t in leaf))
        for depth in range(1, len(self.levels)):
            low, high = low // 2, high // 2
            for at in range(low, high + 1):
                self.levels[depth][at] = self._pair(self.levels[depth - 1], at * 2)

    def _meet(self, pieces: list[tuple[int, int]], first: int, high: int, border: int, end: int, shift: int):
        """(new pieces up to the first common border beyond the edit, old pieces after it), or None if there is none yet."""
        if high == len(self.leaves) - 1:
            return pieces, None
        old, at = {}, border - self.levels[0][high][0]
        for i, (chars, _) in enumerate(self.leaves[high]):
            if at > end:
                old[at + shift] = i
            at += chars
        at = first
        for n, (chars, _) in enumerate(pieces):
            if at in old:
                return pieces[:n], self.leaves[high][old[at]:]
            at += chars
        return None


def edited_counts(docs: DataFrame, edits: Column, path: str = tokens.TOKENIZER_FILE, ranks: str | None = tokens.RANK_FILE) -> DataFrame:
    """Token counts before and after ``edits`` (an array of (start, end, replacement) that apply one after the other).

    Returns doc_id, n_chars, n_tokens, edited (the new text), edited_tokens, reencoded_chars, leaves (tokens per leaf of
    the edited tree). Null texts are empty; null edits are none, and a null replacement is empty. Repeated rows are
    counted each on its own; extra columns are ignored; an empty table gives no rows.
    """
    schema = ("doc_id bigint, n_chars bigint, n_tokens bigint, edited string, edited_tokens bigint, reencoded_chars bigint, "
              "leaves array<bigint>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, ranks)
        for batch in batches:
            rows = []
            for doc_id, text, changes in zip(batch.column(0), batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py(), counter)
                before = (len(tree.text), tree.count)
                for change in changes.as_py() or []:
                    tree.edit(change["start"], change["end"], change["replacement"] or "")
                rows.append((doc_id.as_py(), *before, tree.text, tree.count, tree.reencoded, [t for _, t in tree.levels[0]]))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "n_chars", "n_tokens", "edited", "edited_tokens", "reencoded_chars", "leaves"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", whole().alias("text"), edits.cast(EDITS).alias("edits")).mapInArrow(count, schema)


def op7_token_counts(docs: DataFrame) -> DataFrame:
    """Three edits per text: 16 characters cut at a quarter, its head put in at the middle, 8 characters raised near the end."""
    text, n = whole(), F.char_length(whole()).cast("long")
    quarter, half, late = F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4)

    def change(start: Column, end: Column, replacement: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), replacement.alias("replacement"))

    edits = F.array(
        change(quarter, quarter + 16, F.lit("")),
        change(half, half, F.substring(text, 1, 24)),
        change(late, late + 8, F.upper(F.substring(text, (late + 1).cast("int"), F.lit(8)))))
    return edited_counts(docs, edits).select(
        "doc_id", "n_chars", "n_tokens", F.char_length("edited").cast("long").alias("edited_chars"), "edited_tokens",
        "reencoded_chars", F.size("leaves").cast("long").alias("n_leaves"), F.sha2("edited", 256).alias("edited_sha256"))
