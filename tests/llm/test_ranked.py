"""Ranked search against plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sensorloom.llm import ranked
from tests.llm.conftest import SF, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def by_hand(docs, items, best=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * c.total() * n // length if c else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def found(docs, items, **how):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(ranked.rank_documents(docs, items, **how))), key=repr)


def test_against_plain_scoring(spark, documents, odd):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()]
    many = " ".join(sorted({w for _, t in rows[:8] for w in (t or "").split()})[:180])  # over 64 terms: masks of several numbers
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, many), (901, None), (902, ""), (903, "nowheretobefound"), (None, "some text"), (None, "without an id"), (904, "twice the ROW"), (904, "twice")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, rank int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, terms int")
    assert found(docs, asked) == by_hand(rows, items)
    assert found(docs, asked, best=3, shard_bytes=20_000) == by_hand(rows, items, 3)


def test_blocks_of_items(spark, documents, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(40).collect()]
    items = [(f"i{k}", t) for k, (_, t) in enumerate(rows[:6])]
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, spark.createDataFrame(items, "item_id string, text string")) == by_hand(rows, items)


def test_groups_are_left_out_only_where_they_cannot_matter():
    deal = np.random.default_rng(2)
    terms_, holds, at, times = np.arange(5), [], [], []
    for t in range(5):
        docs = np.flatnonzero(deal.random(300) < 0.1 + 0.2 * t)
        holds.append(len(docs))
        at.append(docs)
        times.append(deal.integers(1, 4, len(docs)))
    shard = ranked.Shard(pa.array(range(300)), deal.integers(5, 9, 300), terms_, np.array(holds), np.concatenate(at), np.concatenate(times), 300, 2000)
    weights, seen = np.array([900, 500, 300, 200, 100]), []
    inner = shard.scores
    whole = inner(np.arange(300), terms_, weights)
    shard.scores = lambda docs, *rest: seen.extend(docs.tolist()) or inner(docs, *rest)
    docs, scores = shard.best(terms_, weights, 7)
    order = np.lexsort((np.arange(300), -whole))[:7]
    assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert len(seen) < 150


def test_nothing(spark, empty, odd):
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert ranked.rank_documents(empty, items).count() == 0
    assert ranked.rank_documents(odd, items.where("item_id = 0")).count() == 0
