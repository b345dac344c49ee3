"""The quality classifier: features, gradients, and accuracy on documents it has not seen."""

import numpy as np
from pyspark.sql import functions as F

from sensorloom.llm import mil
from tests.llm.conftest import rows_of


def test_passages_cover_whole_texts():
    x, owner = mil.passages([b"", b"a " * 200, "é".encode() * 9])
    assert owner.tolist() == [0, 1, 1, 1, 1, 2]
    assert not x[0].any() and np.isfinite(x).all()
    alone, _ = mil.passages([b"a " * 200])
    assert np.allclose(alone, x[1:5])


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    x, owner, y = rng.normal(size=(7, 5)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    model = mil.GatedAttention(5, np.zeros(5), np.ones(5))
    loss = lambda: -np.mean(y * np.log(model.forward(x, owner)[0]) + (1 - y) * np.log(1 - model.forward(x, owner)[0]))
    score, kept = model.forward(x, owner)
    for name, g in model.gradient(y, score, owner, kept).items():
        flat, at = model.p[name].reshape(-1), 1 % model.p[name].size
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert np.isclose((up - down) / 2e-5, g.reshape(-1)[at], atol=1e-6), name


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(size=(rng.integers(1, 8), 4))
        labels.append(float(i % 2))
        if i % 2:
            bag[rng.integers(len(bag)), 0] += 6
        bags.append(bag)
    model = mil.fit(bags[:300], np.array(labels[:300]))
    right = [(model.forward(b, np.zeros(len(b), dtype=int))[0][0] > 0.5) == y for b, y in zip(bags[300:], labels[300:], strict=True)]
    assert np.mean(right) > 0.9


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = mil.predict(docs, mil.train(docs, labels.where(~held_out))).join(labels.where(held_out), "doc_id")
    rows = [(r["score"], r["quality"]) for r in rows_of(scored)]
    hit = np.mean([(s >= 0.3) == (y == 1) for s, y in rows])
    low = np.mean([s < 0.3 for s, y in rows if y == 0])
    assert hit > 0.97 and low > 0.9, (hit, low)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (8, None), (5, 1)], "doc_id long, quality int")
    model = mil.train(odd, labels)
    out = mil.predict(odd.withColumnRenamed("source", "score"), model)
    assert out.count() == odd.count() and all(0 <= r["score"] <= 1 for r in rows_of(out))
    assert mil.predict(empty, model).count() == 0
    assert mil.train(odd, labels.where("1 = 0")) is None and {r["score"] for r in rows_of(mil.predict(odd, None))} == {0.5}
