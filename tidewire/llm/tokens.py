"""Token ids of public tokenizers inside tasks. Tokenizer files are opened where they lie, once per Python worker."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import public_tokenizers
import regex

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Letters, digits, punctuation and spaces whose Unicode classes all regex engines agree on.
# Runs of 400 are left out in the same pass; a run is taken whole or not at all, so the time is in proportion to the text.
_PLAIN = regex.compile(r"(?:[\x21-\x7e¡-ɏ‐-…]{1,399}+(?!\S)|[\t\n\r\x20]{1,399}+(?!\s))*+")
_SPECIAL = "<|endoftext|>"


@functools.cache
def tokenizer(path: str = TOKENIZER_FILE):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(text: str) -> bool:
    """Both libraries split such a text alike, and neither meets a special token or a very long word in it."""
    return _SPECIAL not in text and _PLAIN.fullmatch(text) is not None


def encoder(path: str = TOKENIZER_FILE, ranks: str | None = RANK_FILE) -> Callable[[str], list[int]]:
    """``text -> ids`` of the tokenizer file, without added special tokens.

    ``ranks``: the same vocabulary as a rank file. It serves plain texts about three times as fast with the same ids;
    all other texts, and all texts where it is None, go through the tokenizer file.
    """
    full = tokenizer(path)
    if ranks is None:
        return lambda text: full.encode(text, add_special_tokens=False).ids
    fast = _ranked(ranks).encode_ordinary
    return lambda text: fast(text) if plain(text) else full.encode(text, add_special_tokens=False).ids
