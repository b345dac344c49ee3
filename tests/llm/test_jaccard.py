"""Links between similar shingle sets, against all pairs."""

import os
import random
import re

import pytest

from sensorloom.llm import jaccard
from sensorloom.session import shared_folder
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in rows if d is not None}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if both * 100 >= 80 * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    label[q] = p
    return sorted(repr((d, len(s), None if d is None else top(d))) for d, s in sets)


def same(docs):
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows_of(jaccard.jaccard_components(docs)))
    want = brute([(r["doc_id"], r["text"]) for r in rows_of(docs)])
    assert got == want
    return want


def test_documents(documents, odd, empty):
    same(documents)
    same(odd)
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies(spark, seed):
    """Chains, borderline pairs, and texts that share a passage without being similar."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    passage = " ".join(rng.choices(words, k=12))
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([4, 6, 30, 90]))
        for _ in range(10):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((doc, " ".join(text)))
            doc += 1
            base = text if rng.random() < 0.5 else base
    rows += [(doc + i, passage + " " + " ".join(rng.choices(words, k=rng.choice([2, 3, 5, 9])))) for i in range(40)]
    rng.shuffle(rows)
    want = same(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({w.split(",")[2] for w in want}) < len(want)


def test_the_order_of_frequent_shingles_changes_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 2)
    same(documents)


def test_only_regions_that_cells_may_part_face_all_pivots(spark):
    """A region whose members are near none of its pivots stays whole, whatever else they are near."""
    member = [(region, node) for region, first in ((1, 0), (2, 100), (3, 200), (4, 0)) for node in range(first, first + (20 if region == 3 else 80))]
    chosen = [(1, 0), (1, 1), (2, 100), (2, 101), (3, 200), (3, 201), (4, 2), (4, 3)]
    exact = [(100 + i % 2, 100 + i, 0.3, False) for i in range(2, 80)] + [(200, 200 + i, 0.3, False) for i in range(2, 20)]
    exact += [(0, i, 0.6 if i < 60 else 0.5, False) for i in range(4, 80)] + [(2, 500 + i, 0.1, True) for i in range(90)]
    rows = lambda data, schema: spark.createDataFrame(data, schema).coalesce(2)
    got = jaccard._parting(rows(member, "region long, node long"), rows(chosen, "region long, pivot long"),
                           rows(exact, "a long, b long, exact double, link boolean"), 80)
    assert [r["region"] for r in got.collect()] == [2]  # 1: too few are near; 3: too small; 4: what its pivot is near is elsewhere


def test_tables_of_shingles_do_not_stay(spark):
    """Large tables go once the next is made of them, and whole sets are made of documents in open pairs only."""
    rng = random.Random(3)
    near = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(near[:30 + i % 2])) for i in range(6)] + [(6, " ".join(near[:30]))]
    # many that share a fifth of their shingles with all others of their kind and are compared by bounds alone
    rows += [(10 + i, " ".join([f"v{j}" for j in range(30)] + [f"u{i}x{j}" for j in range(60)])) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).localCheckpoint()
    folder = shared_folder(spark).removeprefix("file:")
    before, made = set(os.listdir(folder)), []
    whole = jaccard._full_sets
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "_full_sets", lambda *a: made.append(whole(*a)) or made[-1])
        found = jaccard.jaccard_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in rows_of(found)}
    assert got == {d: 0 if d < 10 else d for d, _ in rows}
    assert all({r["node"] for r in rows_of(sets)} <= set(range(10)) for sets in made)
    left = [f for f in set(os.listdir(folder)) - before if not f.startswith(".")]
    names = [set(spark.read.parquet(f"{folder}/{f}").columns) for f in left if os.path.isdir(f"{folder}/{f}")]
    assert names and not any({"prefix", "set", "counts"} & n for n in names)
