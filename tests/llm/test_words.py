"""Word hashes: the same whatever texts stand around a word and however they are cut into blocks."""

import numpy as np
import pytest

from sensorloom.llm import words

TEXTS = [b"", b"one two  three", b"x" * 300 + b" two", b" \n", "schön Two".encode(), b"a " * 200, b"three"]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_change_nothing(monkeypatch, block):
    want = words.cut(TEXTS)
    monkeypatch.setattr(words, "BLOCK", block)
    got = words.cut(TEXTS)
    assert all(np.array_equal(getattr(got, c), getattr(want, c)) for c in ("starts", "ends", "text", "hashes"))


def test_equal_words_have_equal_hashes():
    found = words.cut(TEXTS)
    spelled = [bytes(found.buf[a:b]) for a, b in zip(found.starts, found.ends, strict=True)]
    assert len(set(spelled)) == len(set(found.hashes.tolist())) == len(set(zip(spelled, found.hashes.tolist(), strict=True)))
    assert words.cut([]).hashes.tolist() == words.cut([b" "]).hashes.tolist() == []
