"""The LSH forest against all pairs of whole sets."""

import random

import numpy as np
import pytest

from sensorloom.llm import forest
from tests.llm.conftest import rows_of


def shingles(text, k=2):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    at = [i for i, (d, _) in enumerate(rows) if d is not None]
    label = {d: d for d, _ in rows if d is not None}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in at:
        for j in at:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = top(rows[i][0]), top(rows[j][0])
                label[max(a, b)] = min(a, b)
    out = []
    for (d, _), s in zip(rows, sets, strict=True):
        c = None if d is None else top(d)
        out.append((d, len(s), c, d is None or c == d))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(forest.lsh_components(df))), key=repr)


def test_against_all_pairs(spark, documents, odd):
    deal = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    base = [f"w{deal.randrange(900)}" for _ in range(150)]
    for i in range(120):  # a group of variants at and around the threshold
        own = list(base)
        for _ in range(deal.randrange(1, 12)):
            own[deal.randrange(len(own))] = f"x{deal.randrange(10**6)}"
        rows.append((5000 + i, " ".join(own)))
    rows += [(6000, " ".join(base)), (6000, "quite another text of the same id"), (6001, "Quite another\ttext of the same ID"), (6002, "one"), (6003, "One")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int")
    assert found(df) == by_hand(rows)


def test_copies_of_one_text_are_one_class(spark):
    df = spark.range(3000).selectExpr("id + 7 AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('own text number ', id, ' and ', id * 3) ELSE 'the very same text of many' END AS text")
    got = rows_of(forest.lsh_components(df))
    assert sum(r["component_id"] == 8 for r in got) == 2000 and sum(r["kept"] for r in got) == 1001


def test_nothing(empty):
    assert forest.lsh_components(empty).count() == 0


def test_orders_meet_over_the_borders_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 4)
    deal = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(5):
            own = list(base)
            own[deal.randrange(60)] = f"x{deal.randrange(10**6)}"
            rows.append((g * 10 + i, " ".join(own)))
    monkeypatch.setattr(forest, "ROUNDS", ((0, 6, 2), (6, forest.TREES, 3)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_signatures_estimate_similarity():
    deal = np.random.default_rng(3)
    x = np.unique(deal.integers(0, 1 << 62, 4000).astype(np.uint64))
    y = np.unique(np.concatenate([x[:3000], deal.integers(0, 1 << 62, 500).astype(np.uint64)]))
    a, b = forest.signatures([x, y])
    assert (a == b).mean() == pytest.approx(len(np.intersect1d(x, y)) / len(np.union1d(x, y)), abs=0.15)
