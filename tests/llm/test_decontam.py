"""Benchmark windows in documents, against plain Python."""

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from sensorloom.llm import decontam
from tests.llm.conftest import SF, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - width + 1) if b else 0):
            window = b[i:i + width]
            for at in range(len(w) - len(window) + 1):
                if w[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(found)


def same(docs, bench, **options):
    items = [(r["item_id"], r["text"]) for r in rows_of(bench)]
    want = [(r["doc_id"], *brute(r["text"], items)) for r in rows_of(docs)]
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["begin"] for s in r["hit_spans"]), r["hit_items"])
           for r in rows_of(decontam.benchmark_hits(docs, bench, **options))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return want


def test_against_plain_python(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = rows_of(documents)
    planted = " ".join(r["text"] for r in rows_of(bench)[:3])
    extra = spark.createDataFrame([(9001, "x " + planted + " y " + planted), (9002, planted[:40])], "doc_id long, text string")
    want = same(documents.select("doc_id", "text").where("length(text) < 4000").unionByName(extra), bench)
    assert len(rows) and any(n for _, _, n, _ in want)


def test_odd_rows_and_items(spark, odd, empty):
    bench = spark.createDataFrame(
        [(1, "same"), (2, "and1 word2"), (3, None), (4, " .. "), (None, "日本語"), (1, "twice the same row"), (5, "same")],
        "item_id long, text string")
    same(odd, bench)
    same(odd, bench, block_words=1)
    assert decontam.benchmark_hits(empty, bench).count() == 0
    assert all(not r["hit_spans"] for r in rows_of(decontam.benchmark_hits(odd, bench.where("1 = 0"))))


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b c d e f g h i j, and that.", "x")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert rows_of(decontam.without_hits(docs, bench, max_share=0.9))[0]["text"] == "Keep this. , and that."
    assert decontam.without_hits(docs, bench, max_share=0.5).count() == 0


def test_spans_are_searched_and_cut_out_in_one_step(spark):
    rows = [(1, "x a b c d e y. tail", "s"), (2, "a b c", "s"), (3, None, None), (3, None, None), (None, "", "s"), (4, "none here", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e")], "item_id long, text string")
    for block_words, steps in ((1_000, 1), (1, 2)):
        clean = decontam.without_hits(docs, bench, max_share=0.7, block_words=block_words)
        # each Arrow step holds a Python worker of its own in every task
        assert clean._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == steps
        assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, [
            (1, "x  y. tail", "s"), (3, None, None), (3, None, None), (None, "", "s"), (4, "none here", "s")]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_index_finds_all_places(body):
    body = np.array(body, dtype=np.int64)
    index = decontam.FMIndex(body, 4)
    patterns = [(a, b, c)[:n] for n in (1, 2, 3) for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)]
    table = np.zeros((len(patterns), 3), dtype=np.int64)
    for i, p in enumerate(patterns):
        table[i, :len(p)] = p
    low, high = index.ranges(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(body) - len(p) + 1) if tuple(body[i:i + len(p)]) == p]
        assert sorted(index.places(np.arange(a, b)).tolist()) == want
