"""Operator 8: benchmark passages in training documents, found in an FM-index per shard of documents.

A shard is what fits into a few MB of text. Its words become symbols: benchmark words by number, every other word one
separator, since no window reaches across it. Runs of benchmark words too short to hold any window are
left out before indexing, which loses nothing. The index has the suffix array's order, the
Burrows-Wheeler transform in a wavelet tree of bit ranks, and suffix positions sampled by place; each
window is searched from its last word backwards and its occurrences are found by walking back to a sample.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, text_slices
from sensorloom.llm.words import ALNUM, cut

WINDOW, SAMPLE, SHARD_BYTES, BLOCK_WORDS = 10, 8, 2_000_000, 2_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Bits:
    """A bit vector that counts its ones before a place."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.ones = np.zeros(len(bits) + 1, dtype=np.int32)
        np.cumsum(bits, out=self.ones[1:])


class Wavelet:
    """A sequence of numbers by bit levels, highest first, each level stably parted by its bit."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append((level, Bits(bit), len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``place`` values."""
        begin, end = np.zeros_like(place), place.copy()
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            b, e = bits.ones[begin], bits.ones[end]
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return end - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for level, bits, zeros in self.levels:
            one, b = bits.bits[place], bits.ones[place]
            out |= one.astype(place.dtype) << level
            place = np.where(one, zeros + b, place - b)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    group = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[order] = group
    size = np.diff(np.append(heads, n))
    tied = np.repeat(size > 1, size).nonzero()[0]
    k = 1
    while len(tied):
        suffix = order[tied]
        key = rank[suffix] * np.int64(n + 2) + rank[np.minimum(suffix + k, n)] + 1
        by = np.argsort(key, kind="stable")
        order[tied], key = suffix[by], key[by]
        new = np.diff(key, prepend=key[0] - 1) != 0
        first = tied[new]
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        rank[order[tied]] = np.repeat(first, size)
        tied = tied[np.repeat(size > 1, size)]
        k *= 2
    return order


class FMIndex:
    """Symbols are at least 1; a 0 is put at the end."""

    def __init__(self, symbols: np.ndarray, top: int):
        body = np.append(symbols, 0)
        order = suffix_order(body)
        self.n = len(body)
        self.below = np.zeros(top + 2, dtype=np.int64)
        np.cumsum(np.bincount(body, minlength=top + 1), out=self.below[1:])
        self.tree = Wavelet(body[order - 1], top)
        self.marked = Bits(order % SAMPLE == 0)
        self.samples = order[self.marked.bits]

    def ranges(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with each pattern, searched from its last symbol to its first."""
        low = np.zeros(len(sizes), dtype=np.int64)
        high = np.full(len(sizes), self.n, dtype=np.int64)
        for back in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((sizes >= back) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, sizes[on] - back]
            low[on] = self.below[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.below[symbol] + self.tree.rank(symbol, high[on])
        return low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back until a sampled one."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.marked.bits[rows]
            out[left[done]] = self.samples[self.marked.ones[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            if len(left):
                symbol = self.tree.at(rows)
                rows = self.below[symbol] + self.tree.rank(symbol, rows)
            steps += 1
        return out


class Windows:
    """Distinct windows of some benchmark items as symbols, with the items each is of."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number) + 2) for w in _WORD.findall(text.lower())]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i:i + width]), set()).add(item)
        self.top = len(number) + 1
        hashes = cut(list(number), ALNUM).hashes if number else np.zeros(0, dtype=np.uint64)
        by = np.argsort(hashes)
        self.word_hashes, self.symbols = hashes[by], (by + 2).astype(np.int64)
        self.sizes = np.array([len(w) for w in windows], dtype=np.int64)
        self.patterns = np.zeros((len(windows), width), dtype=np.int64)
        for i, w in enumerate(windows):
            self.patterns[i, :len(w)] = w
        self.items = list(windows.values())
        self.shortest = int(self.sizes.min()) if len(windows) else 0

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, merged hit spans of words (end exclusive), and items."""
        words = cut(texts, ALNUM)
        first = words.first()
        out = [(int(n), [], set()) for n in np.diff(first)]
        if not len(self.sizes) or not len(words.hashes):
            return out
        slot = np.minimum(np.searchsorted(self.word_hashes, words.hashes), len(self.word_hashes) - 1)
        known = self.word_hashes[slot] == words.hashes
        cuts = known.copy()  # a run of known words ends at an unknown one and at a text's end
        begins = np.flatnonzero(cuts & ~np.append(False, cuts[:-1] & (words.text[1:] == words.text[:-1])))
        stops = np.flatnonzero(cuts & ~np.append(cuts[1:] & (words.text[1:] == words.text[:-1]), False)) + 1
        long = stops - begins >= self.shortest
        begins, stops = begins[long], stops[long]
        if not len(begins):
            return out
        sizes = stops - begins
        starts = np.cumsum(sizes + 1) - sizes - 1
        body = np.ones(int((sizes + 1).sum()), dtype=np.int64)
        origin = np.repeat(begins - starts, sizes + 1) + np.arange(len(body))
        inside = np.ones(len(body), dtype=bool)
        inside[starts + sizes] = False
        body[inside] = self.symbols[slot[origin[inside]]]
        index = FMIndex(body, self.top)
        low, high = index.ranges(self.patterns, self.sizes)
        count = high - low
        hit = np.flatnonzero(count > 0)
        count = count[hit]
        for part in np.array_split(np.arange(len(hit)), max(1, int(count.sum()) // 1_000_000)):
            if not len(part):
                continue
            rows = np.repeat(low[hit[part]] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(count[part].sum())
            window = np.repeat(hit[part], count[part])
            at = origin[index.places(rows)]
            for text, begin, end, w in sorted(zip(
                words.text[at].tolist(), (at - first[words.text[at]]).tolist(),
                (at - first[words.text[at]] + self.sizes[window]).tolist(), window.tolist(), strict=True,
            )):
                out[text][1].append((begin, end))
                out[text][2].update(self.items[w])
        return [(n, merged(spans), items) for n, spans, items in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text: str = "text",
    item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Where documents repeat ``width`` words in a row of a benchmark item.

    Adds to all rows and columns of ``docs``: n_words, hit_spans (array of [begin, end) in words, merged),
    hit_items (sorted item ids as strings); columns of these names are replaced. An item of fewer words
    is one window; items or texts that are null or have no words hit nothing; repeated items and rows are
    each treated as they come.

    The benchmark is a stated query set. It is read in blocks of about ``block_words`` words, one block on
    the driver at a time while planning; each block is one more pass over the documents.
    """
    body, blocks = _begun(docs, benchmark, item, item_text, block_words)
    for block in blocks:
        body = _searched(body, _windows(block, width), text)
    return body


def _begun(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, block_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Documents without hits so far, and the blocks of the benchmark."""
    asked = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")
    ).where("text IS NOT NULL").distinct()
    bytes_in = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-bytes_in // (6 * block_words)))
    keep = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    body = docs.select(*keep).withColumns({
        "n_words": F.lit(0).cast("long"),
        "hit_spans": F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        "hit_items": F.array().cast("array<string>"),
    })
    return body, [asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) for block in range(blocks)]


def _windows(block: DataFrame, width: int) -> Windows:
    return Windows([(r["item"], r["text"].encode()) for r in block.toLocalIterator()], width)


def _searched(docs: DataFrame, windows: Windows, text: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema=None) -> DataFrame:
    """Hits of one block added to those before. ``then`` goes on with each batch, in the same Python worker: chained
    Arrow steps hold a worker each, for every task."""
    names = docs.columns

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x for texts in text_slices(batch.column(text), SHARD_BYTES) for x in windows.find(texts)]
        old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
        spans = [merged([*new, *((s["begin"], s["end"]) for s in old)]) for (_, new, _), old in zip(found, old_spans, strict=True)]
        items = [sorted({*new, *old}) for (_, _, new), old in zip(found, old_items, strict=True)]
        made = {
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "hit_spans": pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans],
                                  pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
            "hit_items": pa.array(items, pa.list_(pa.string())),
        }
        out = pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)
        return then(out) if then else out

    return arrow_rows(docs, schema or docs.schema, search)


def item_digest() -> Column:
    """SHA-256 of the comma-joined item ids."""
    return F.sha2(F.array_join("hit_items", ","), 256)


def without_hits(
    docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, text: str = "text", width: int = WINDOW,
    item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without their hit words: the removal spans of :func:`benchmark_hits` are cut out.

    A document of which more than ``max_share`` of the words are hit goes. Text outside the spans stays as
    it is; untouched documents are returned unchanged. Columns are those of ``docs``.
    """
    names = docs.columns

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, words = batch.column("hit_spans").to_pylist(), batch.column("n_words").to_pylist()
        stay = [sum(s["end"] - s["begin"] for s in found) <= n * max_share for found, n in zip(spans, words, strict=True)]
        batch, spans = batch.filter(pa.array(stay, pa.bool_())), [s for s, x in zip(spans, stay, strict=True) if x]
        out = [_without(t, s) if s else t for t, s in zip(batch.column(text).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(out, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    body, (*blocks, last) = _begun(docs, benchmark, item, item_text, block_words)
    for block in blocks:
        body = _searched(body, _windows(block, width), text)
    return _searched(body, _windows(last, width), text, cut_out, docs.schema)


def _without(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    words = [(m.start(), m.end()) for m in _WORD.finditer(raw.lower())]
    out, at = [], 0
    for span in spans:
        out.append(raw[at:words[span["begin"]][0]])
        at = words[span["end"] - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()
