"""Packing: the pieces are the tokenizer's, places do not overlap, reductions cost nothing."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sensorloom.llm import packing
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, c):
    """Fewest bins by trying all ways, for a handful of items."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i]:
                go(i + 1, (*rooms[:k], rooms[k] - items[i], *rooms[k + 1:]))
        go(i + 1, (*rooms, c - items[i]))

    items = sorted(items, reverse=True)
    go(0, ())
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fixed_sets_lose_nothing(items):
    counts = dict(Counter(items))
    fixed = packing.reduce_dominated(counts, 20)
    rest = [w for w, n in counts.items() for _ in range(n)]
    assert all(sum(w * n for w, n in runs) <= 20 for runs, _ in fixed)
    taken = Counter()
    for runs, times in fixed:
        taken.update({w: n * times for w, n in runs})
    assert taken + Counter(rest) == Counter(items)
    assert sum(times for _, times in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1))
def test_plan_places_every_piece_once(counts):
    places, n = packing.plan(counts, 50)
    filled = defaultdict(list)
    for w, many in counts.items():
        mine = places[places[:, 0] == w]
        for rank in range(many):
            _, first, each, sequence, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            filled[sequence + (rank - first) // each].append((offset + (rank - first) % each * w, w))
    assert len(filled) == n
    for spans in filled.values():
        ends = [0, *itertools.accumulate(w for _, w in sorted(spans))]
        assert [at for at, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 50


def check(docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    got = rows_of(packing.pack(docs, PATH, capacity))
    want = []
    for r in rows_of(docs):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], dtype="<u4")
            want.append((r["doc_id"], i, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled), sum(r["length"] for r in got)


def test_documents(documents, odd, empty):
    n, total = check(documents, 4096)
    assert n <= -(-total // 4096) + 1
    check(odd, 4096)
    check(odd, 64)
    assert packing.pack(empty, PATH).count() == 0


def test_words_give_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["It's THE <|endoftext|>end don't stop now İΣ é ́x  a<|startoftext|> b", "x\r\n\x0b\x0c\ty\x1cz\x85w", "'s 'Sſ 12a3 ab''ll", "<|ENDOFTEXT|> The end. a<|b.", "The THE the, The. x... y?! d1, 1. é. e\u0301. I\u0307. I\u0307 don't. can't, #a. ##. a_. b'., It's*** %%%", "﻿a ​b 日本 \U0001F600"]
    for text, ids in zip(texts, packing.Encoder(PATH).encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
