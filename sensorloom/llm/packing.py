"""Operator 3: documents packed into sequences of a fixed number of tokens.

How a bin packing is planned depends only on how many pieces there are of each length, and there are at most
``capacity`` lengths. The plan is made from that histogram, whatever the number of documents:

* Martello and Toth's reduction: a set of up to three pieces that dominates every other feasible set with
  its largest piece is fixed for good, as often as there are pieces for it, and the instance shrinks.
* What is left goes by best fit, longest first, whole classes of equal sequences at a time.

A piece finds its place by its rank among the pieces of its length. Ranks come from runs of about
256 pieces, so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.llm.common import arrow_rows, stored, text_slices
from sensorloom.llm.words import U, cut, mix

CAPACITY, RUN = 4096, 256
_ENCODERS: dict = {}


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    No token of this tokenizer spans white space, nor a letter or digit and the punctuation after it, and it
    lower-cases. So texts are cut into words at once, and distinct words (without the punctuation at their end) are
    encoded once and remembered by their hash, in flat arrays of bounded size. Special tokens are found before
    lower-casing: words of a text that may hold one keep their case and are not remembered.
    """

    #: Words, and ids of all of them together.
    REMEMBERED, IDS = 1_000_000, 4_000_000
    _TAIL = b".,;:!?*#$%&"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # rising hashes, where each word's ids begin, how many they are, and all ids
        self.keys, self.begin, self.size, self.ids = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        cased = {i for i, t in enumerate(texts) if b"<|" in t}
        words = cut([b"" if i in cased else t for i, t in enumerate(texts)])
        distinct, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.REMEMBERED or len(self.ids) > self.IDS:  # what occurs right now is what occurs often
            self._keep(np.unique(self._at(distinct)[1]))
        new = first[~self._at(distinct)[0]].tolist()
        self._learn([words.buf[a:b].tobytes() for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)], words.hashes[new])
        at = self._at(distinct)[1][place]
        size = self.size[at]
        ids = self._gather(self.begin[at], size)
        ends = np.concatenate([[0], np.cumsum(size)])[words.first()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in cased:
            out[i] = b"".join(x for _, x in self._ids_of([w.decode() for w in texts[i].split()], [b""] * len(texts[i].split()), ordered=True))
        return out

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are remembered, and their places."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[at] == hashes
        return there, at if there.all() else at[there]

    def _gather(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def _keep(self, at: np.ndarray) -> None:
        size = self.size[at]
        self.ids = self._gather(self.begin[at], size)
        self.keys, self.begin, self.size = self.keys[at], np.cumsum(size) - size, size

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Remember words that are not: those with punctuation at their end by what they are made of."""
        if not words:
            return
        halves, parts = {}, set()
        for word in words:
            body = word.rstrip(self._TAIL)
            if len(body) == len(word) or not body[-1:].isalnum():
                parts.add(word)
            else:
                halves[word] = body, word[len(body):]
                parts.update(halves[word])
        parts = list(parts)
        named = cut([b"\n".join(parts)]).hashes
        there, at = self._at(named)
        known = {parts[i]: self.ids[a:a + n].tobytes() for i, a, n in zip(np.flatnonzero(there).tolist(), self.begin[at].tolist(), self.size[at].tolist(), strict=False)}
        missing = [p for p, x in zip(parts, there.tolist(), strict=True) if not x]
        known.update(self._ids_of([p.decode() for p in missing], missing))
        found = [known[halves[w][0]] + known[halves[w][1]] if w in halves else known[w] for w in words] + [known[p] for p in missing]
        keys, first = np.unique(np.concatenate([hashes, named[~there]]), return_index=True)
        size = np.array([len(x) // 4 for x in found], dtype=np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = (np.insert(old, at, more) for old, more in ((self.keys, keys), (self.begin, begin[first]), (self.size, size[first])))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype="<u4")])

    def _ids_of(self, words: list[str], keys: list[bytes], ordered: bool = False) -> list[tuple[bytes, bytes]]:
        """Key and ids of each word, in their order if asked. Words of letters alone are one unit each, so many go in one text and are told apart by
        the tokens that end a unit."""
        plain = [] if ordered else [i for i, w in enumerate(words) if w.isalpha()]
        rows = [" ".join([words[i] for i in plain[a:a + 256]]) for a in range(0, len(plain), 256)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], dtype="<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        out = []
        if len(stops) == len(plain):
            raw = ids.tobytes()
            out = [(keys[i], raw[4 * a:4 * b]) for i, a, b in zip(plain, [0, *stops], stops, strict=False)]
            done = set(plain)
        else:
            done = set()
        rest = [i for i in range(len(words)) if i not in done]
        found = self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
        return out + [(keys[i], array("I", e.ids).tobytes()) for i, e in zip(rest, found, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def dominant_set(lengths: list[int], counts: dict[int, int], j: int, c: int) -> tuple[int, ...] | None:
    """The set with ``j`` that dominates all others with it, if three pieces suffice to show it.

    ``lengths``: those present, rising. A set dominates another if each of the other's pieces fits into the
    place of one of its own.
    """
    def below(limit: int, used: tuple[int, ...]) -> int:
        """The largest length up to ``limit`` of which more than the used pieces are there, or 0."""
        at = bisect.bisect_right(lengths, limit) - 1
        while at >= 0 and counts[lengths[at]] <= used.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def smallest(n: int, over: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for w in lengths[bisect.bisect_right(lengths, over):]:
            out += [w] * min(n - len(out), counts[w] - used.count(w))
            if len(out) == n:
                break
        return out

    room = c - j
    small = smallest(3, 0, (j,))
    if not small or small[0] > room:
        return (j,)
    x = below(room, (j,))
    if x == room or len(small) < 2 or small[0] + small[1] > room:
        return (j, x)
    if len(small) == 3 and sum(small) <= room:
        return None
    a, b = 0, 0
    for w in reversed(lengths[:bisect.bisect_right(lengths, x)]):
        if 2 * w < a + b:
            break
        if counts[w] <= (j,).count(w):
            continue
        other = below(min(w, room - w), (j, w))
        if other and w + other > a + b:
            a, b = w, other
    if x >= a + b:
        return (j, x)
    rivals = smallest(2, b, (j,))
    if x == a and (len(rivals) < 2 or sum(rivals) > room):
        return (j, a, b)
    return None


def reduce_dominated(counts: dict[int, int], c: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix dominating sets and take their pieces out of ``counts``; pass by pass until none is found."""
    fixed, found = [], True
    while found:
        found = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                chosen = dominant_set(sorted(counts), counts, j, c)
                if chosen is None:
                    break
                found, need = True, Counter(chosen)
                times = min(counts[w] // n for w, n in need.items())
                fixed.append((sorted(need.items(), reverse=True), times))
                for w, n in need.items():
                    counts[w] -= n * times
                    if not counts[w]:
                        del counts[w]
    return fixed


def best_fit(counts: dict[int, int], c: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first into the fullest sequence with room. Equal sequences are one class."""
    done, free = [], []  # free: rooms of open classes, rising
    held: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(runs, times, room):
        if times and room:
            if room not in held:
                held[room] = []
                bisect.insort(free, room)
            held[room].append((runs, times))
        elif times:
            done.append((runs, times))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            at = bisect.bisect_left(free, w)
            if at == len(free):
                runs, times, room = [], -(-left // (c // w)), c
            else:
                room = free[at]
                runs, times = held[room].pop()
                if not held[room]:
                    del held[room], free[at]
            each = room // w
            full = min(times, left // each)
            put([*runs, (w, each)], full, room - each * w)
            left -= full * each
            if full < times:
                some = left  # fewer than fill one more sequence
                if some:
                    put([*runs, (w, some)], 1, room - some * w)
                put(runs, times - full - bool(some), room)
                left = 0
    return done + [x for classes in held.values() for x in classes]


def plan(counts: dict[int, int], c: int) -> tuple[np.ndarray, int]:
    """Places by length and rank: rows (length, first rank, pieces per sequence, first sequence, offset)."""
    counts = {int(w): int(n) for w, n in counts.items() if n}
    patterns = reduce_dominated(counts, c)
    patterns += best_fit(counts, c)
    rows, ranks, sequence = [], Counter(), 0
    for runs, times in patterns:
        offset = 0
        for w, n in runs:
            rows.append((w, ranks[w], n, sequence, offset))
            ranks[w] += n * times
            offset += n * w
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        end = np.array([end_id], dtype="<u4").tobytes()
        ids_of = (ids for texts in text_slices(batch.column("text")) for ids in encoder(tokenizer).encode(texts))
        for doc, ids in zip(batch.column("key").to_pylist(), ids_of, strict=True):
            ids += end
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return arrow_rows(source, "doc_id long, piece int, start long, length long, ids_crc32 long", run)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack the token pieces of all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the end id alone. Repeated rows and rows with null ids are packed like any others. No rows, no sequences.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, text, key))
    # at most `capacity` rows, whatever the number of documents
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan(counts, capacity)
    order = places[:, 0] << 40 | places[:, 1]
    runs = np.ones(capacity + 1, dtype=np.int64)
    for w, n in counts.items():
        runs[w] = -(-n // RUN)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy()
        doc = batch.column("doc_id").fill_null(0).to_numpy().astype(U)
        with np.errstate(over="ignore"):
            spread = mix(mix(doc) + batch.column("piece").to_numpy().astype(U)) >> U(1)
        run = spread.astype(np.int64) % runs[length]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], names=[*batch.schema.names, "run"])

    dealt = arrow_rows(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, run long", deal)
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "run").agg(F.count("*").alias("n")).select(
        "length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "run").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(bases, ["length", "run"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(order, length << 40 | rank, side="right") - 1
        _, first, each, sequence, offset = places[at].T
        back = rank - first
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence + back // each), pa.array(offset + back % each * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_rows(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place)
