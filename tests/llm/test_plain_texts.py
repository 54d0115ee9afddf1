"""Which texts the rank file may serve, and that finding out takes time in proportion to their length."""

import time

import pytest

from tidewire.llm import tokens


@pytest.mark.parametrize("text, plain", [
    ("", True), ("a" * 399 + " b", True), ("a" * 400, False), ("b " + "é" * 400, False), ("a" + " " * 399 + "b", True), (" " * 400, False),
    ("a\n" + "\t " * 200, False), ("word   word", False), ("слово", False), ("a <|endoftext|> b", False), ("x – y…", True), ("\x0b", False),
])
def test_plain_texts(text, plain):
    assert tokens.plain(text) is plain


def test_long_words_take_time_in_proportion():
    text = ("a" * 399 + " ") * 10_000
    start = time.process_time()
    assert tokens.plain(text)
    assert time.process_time() - start < 1.5
