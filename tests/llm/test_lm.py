"""Language-model scores: the base against plain Python, the automaton against its formula, sums to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import lm
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), END]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


class Plain:
    """The same model from its formulas, with dictionaries."""

    def __init__(self, rows, mu):
        learn = [tokens(t) for d, t in rows if not held(d)]
        self.c, self.mu = Counter(w for t in learn for w in t), mu
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.two = Counter(x for t in learn for x in zip([END, *t], t, strict=False))
        self.three = Counter(x for t in learn for x in zip([END, *t], t, t[1:], strict=False))

    def p0(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, u, v, w):
        p1 = (self.two[v, w] + self.mu[0] * self.p0(w)) / (self.c[v] + self.mu[0])
        return p1 if u == ".none" else (self.three[u, v, w] + self.mu[1] * p1) / (self.two[u, v] + self.mu[1])

    def state(self, read):
        """The longest context of at most two words, the start's end with them, that the training texts have."""
        words = [END, *read][-2:]
        return tuple(words) if len(words) == 2 and self.two[tuple(words)] else tuple(words[-1:]) if self.c[words[-1]] else ()


@pytest.mark.parametrize("shard_bytes", [20_000, 16_000_000])
def test_against_the_formulas(documents, odd, shard_bytes):
    docs = documents.select("doc_id", "text").where("length(text) < 12000").unionByName(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    got = rows_of(lm.score(docs, mu=(30.0, 5.0), shard_bytes=shard_bytes))
    plain = Plain(rows, (30.0, 5.0))
    assert plain.v > 1024 and max(len(tokens(t)) for _, t in rows) > lm.STRETCH
    want = []
    for d, t in rows:
        ts = tokens(t)
        padded = [".none", END, *ts]
        want.append((d, held(d), len(ts), sum(plain.c[w] > 0 for w in ts), plain.n,
                     sum(math.log10(plain.p0(w)) for w in ts), sum(math.log10(plain.p(*padded[i:i + 3])) for i in range(len(ts)))))
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def small_automaton(rows, mu):
    """The automaton of some texts, its plain twin, the words by number, the tokens and their numbers."""
    plain = Plain(rows, mu)
    texts = [tokens(t) for _, t in rows]
    words = sorted({w for t in texts for w in t}, key=str)
    number = {w: i for i, w in enumerate(words)}
    flat = np.array([number[w] for t in texts for w in t])
    sizes = np.array([len(t) for t in texts])
    c2 = np.array([plain.two[x] for t in texts for x in zip([END, *t], t, strict=False)])
    c3 = np.array([plain.three[x] for t in texts for x in zip([END, *t], t, t[1:], strict=False)])
    seen = np.array([plain.c[w] for w in words])
    return lm.Automaton(seen, number[END], flat, sizes, c2, c3, plain.n + 0.5 * (plain.v + 1), mu), plain, words, texts, flat, sizes


LEARNED = ["a b a b c", "a b d e", "b a b a", "x y z a b", "a b a c", ""]
HELD = ["q a b q q a", "e d b a a a b", "never ever a b c d", "b a b a c b"]
ROWS = [*zip([i for i in range(99) if not held(i)], LEARNED, strict=False), *zip([i for i in range(99) if held(i)], HELD, strict=False)]


def test_states_and_probabilities_of_the_walk():
    automaton, plain, words, texts, flat, _ = small_automaton(ROWS, (2.0, 1.0))
    at, longest, failed = 0, 0, 0
    for text in texts:
        state = np.array([automaton.start])
        padded = [".none", END, *text]
        for i in range(len(text)):
            before = len(automaton.context(int(state[0])))
            state, log = automaton.step(state, flat[at + i:at + i + 1])
            context = tuple(words[w] for w in automaton.context(int(state[0])))
            assert context == plain.state(text[:i + 1])
            assert log[0] == pytest.approx(math.log10(plain.p(*padded[i:i + 3])), abs=1e-12)
            longest, failed = max(longest, len(context)), failed + (len(context) < before)
        at += len(text)
    assert longest == 2 and failed


@pytest.mark.parametrize("stretch", [2, 3, 1000])
def test_stretches_change_nothing(stretch):
    automaton, plain, _, texts, flat, sizes = small_automaton(ROWS, (2.0, 1.0))
    want = [sum(math.log10(plain.p(*[".none", END, *t][i:i + 3])) for i in range(len(t))) for t in texts]
    assert automaton.read(flat, sizes, stretch).tolist() == pytest.approx(want)


def test_probabilities_sum_to_one():
    plain = Plain(ROWS, (2.0, 1.0))
    unseen = 0.5 / (plain.n + 0.5 * (plain.v + 1))
    for u, v in (("a", "b"), (END, "a"), ("x", "b"), ("b", "x"), (".none", END)):
        factor = plain.p(u, v, "unheard") / unseen
        assert sum(plain.p(u, v, w) for w in plain.c) + factor * unseen == pytest.approx(1)


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in rows_of(lm.score(docs)) if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_nothing_to_score(empty):
    assert lm.score(empty).count() == 0
