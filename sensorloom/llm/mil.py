"""Operator 6: text quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by the shape of its text and
hashed word counts, and encoded by one hidden layer. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))),
weighs the passages; a logistic unit scores the weighted passage representation. Only documents carry labels;
attention learns which passages they are about.

The model is fitted on the driver on a bounded sample of labelled documents (``SAMPLE`` documents, the smallest
hashes of their ids, up to ``BAG`` passages of each); scoring reads every passage of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, text_slices
from sensorloom.llm.words import U, cut

PASSAGE, SAMPLE, BAG, HASHED, HIDDEN, GATE = 64, 6000, 48, 32, 24, 12


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Classes of bytes whose shares describe a passage.
CLASSES = (
    _mask(b"#*$%&|<>~^=_\\"), _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(b"!?"), _mask(b"0123456789"),
    _mask(b".,;:"), _mask(b"\n"), _mask(b"{}[]()\"'@/"), np.arange(256) >= 128,
)
FEATURES = len(CLASSES) + 7 + HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text each is of; a text without words has one of zeros."""
    words = cut(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    first = words.first()
    n = np.diff(first)
    per_text = np.maximum(1, -(-n // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), per_text)
    base = np.cumsum(per_text) - per_text
    out = np.zeros((len(owner), FEATURES), dtype=np.float32)
    out[:, -1] = np.log1p(n)[owner] / 5
    if not len(words.hashes):
        return out, owner
    group = base[words.text] + (np.arange(len(words.text)) - first[words.text]) // PASSAGE
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    g = group[begin]
    last = np.append(begin[1:], len(group)) - 1
    count = (last - begin + 1).astype(np.float32)
    size = (words.ends[last] - words.starts[begin]).astype(np.float32)
    for i, chars in enumerate(CLASSES):
        sums = np.cumsum(np.append(0, chars[raw]), dtype=np.int64)
        out[g, i] = (sums[words.ends[last]] - sums[words.starts[begin]]) / size
    length = (words.ends - words.starts).astype(np.float64)
    at = len(CLASSES)
    out[g, at] = np.log1p(count) / 4
    out[g, at + 1] = np.add.reduceat(length, begin) / count / 10
    out[g, at + 2] = np.add.reduceat(length <= 3, begin, dtype=np.float64) / count
    order = np.lexsort((words.hashes, group))
    fresh = np.diff(words.hashes[order], prepend=U(0)) != 0
    fresh |= np.diff(group[order], prepend=-1) != 0
    out[g, at + 3] = np.bincount(group[order][fresh], minlength=len(owner))[g] / count
    again = np.append(False, (words.hashes[1:] == words.hashes[:-1]) & (group[1:] == group[:-1]))
    out[g, at + 4] = np.add.reduceat(again, begin, dtype=np.float64) / count
    spread = np.add.reduceat(length * length, begin) / count - (np.add.reduceat(length, begin) / count) ** 2
    out[g, at + 5] = np.sqrt(np.maximum(spread, 0)) / 10
    bags = np.bincount(group * HASHED + (words.hashes % U(HASHED)).astype(np.int64), minlength=len(owner) * HASHED)
    out[:, at + 6:at + 6 + HASHED] = bags.reshape(-1, HASHED)
    out[g, at + 6:at + 6 + HASHED] /= count[:, None]
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class GatedAttention:
    """The network and its gradient. Bags lie behind each other; ``owner`` rises from 0 without gaps."""

    def __init__(self, features: int, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.std = mean, std
        self.p = {"W": draw(features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
                  "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        e = np.exp(e - np.maximum.reduceat(e, begin)[owner])
        a = e / np.add.reduceat(e, begin)[owner]
        z = np.add.reduceat(a[:, None] * h, begin)
        return _sigmoid(z @ p["c"] + p["d"]), {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "begin": begin}

    def gradient(self, y: np.ndarray, score: np.ndarray, owner: np.ndarray, k: dict) -> dict[str, np.ndarray]:
        p, h, t, s, a = self.p, k["h"], k["t"], k["s"], k["a"]
        g = (score - y) / len(y)
        dz = g[:, None] * p["c"]
        da = (dz[owner] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, k["begin"])[owner])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": k["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": k["z"].T @ g, "d": np.array([g.sum()])}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
    """Adam over batches of bags."""
    every = np.concatenate(bags)
    model = GatedAttention(every.shape[1], every.mean(0), every.std(0) + 1e-3, seed)
    rng = np.random.default_rng(seed)
    one, two, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(epochs):
        speed = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for a in range(0, len(order), batch):
            chosen = order[a:a + batch]
            owner = np.repeat(np.arange(len(chosen)), [len(bags[i]) for i in chosen])
            score, kept = model.forward(np.concatenate([bags[i] for i in chosen]), owner)
            step += 1
            for name, g in model.gradient(labels[chosen], score, owner, kept).items():
                g = g + decay * model.p[name]
                one[name] = 0.9 * one[name] + 0.1 * g
                two[name] = 0.999 * two[name] + 0.001 * g * g
                model.p[name] = model.p[name] - speed * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> GatedAttention | None:
    """Fit on up to ``sample`` labelled documents; null without any."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("double").alias("y"))
    # at most `sample` small rows
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "text", "y")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = []
        for texts in text_slices(batch.column("text")):
            x, owner = passages(texts)
            for i in range(len(texts)):
                mine = x[owner == i]
                # evenly spread passages of long texts
                blobs.append(mine[np.unique(np.linspace(0, len(mine) - 1, min(BAG, len(mine))).astype(int))].tobytes())
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(blobs, pa.binary())], names=["key", "y", "bag"])

    bags = arrow_rows(rows, f"key {docs.schema[key].dataType.simpleString()}, y double, bag binary", describe).dropDuplicates(["key"]).collect()
    bags = sorted(bags, key=lambda r: r["key"])
    if not bags:
        return None
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in bags], np.array([r["y"] for r in bags]), seed=seed)


def predict(docs: DataFrame, model: GatedAttention | None, text: str = "text") -> DataFrame:
    """Add ``score`` (replaced if there) to all rows and columns but the text, from all passages of the text.

    Null, empty and wordless texts are one passage of zeros and get that passage's score; without a model all
    scores are 0.5.
    """
    keep = [c for c in docs.columns if c not in (text, "score")]
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [np.full(len(t), 0.5) if model is None else model.forward(*passages(t))[0] for t in text_slices(batch.column(text))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.concatenate(scores))], names=[*keep, "score"])

    return arrow_rows(docs, schema, run)
