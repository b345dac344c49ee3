"""Operator 13: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes. The byte offsets where tokens of both end cut a text into groups, and all tokens of
a group are linked across. The common offsets are found by a galloping intersection: for every text the shorter list of ends
drives, and each of its ends is searched in the longer one from the place of the one before, in steps that double, then
by halves. Stretches of ends gallop side by side, an array element each, so that many short texts or one long one are
equally much work. Ranks of common ends slice the groups; their differences are the ranges of tokens that overlap.

How many documents hold a pair of ids linked is a count over the corpus. Documents lie in shards of some MB, written
once with the distinct pairs of each document. A shard sends its distinct pairs with its counts; they are summed
with map-side combining, and each shard gets the sums of its own pairs back. What is sent grows with the number of shards and
what a shard has; a pair that all shards have is one row a shard.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import SLICE, release, slices, stored

SHARD_BYTES = 8_000_000
#: Ends that gallop one after the other; all such stretches of a slice of texts go side by side.
STRETCH = 256
#: Links of one group that are written out; larger groups are counted by their distinct ids.
WRITTEN_OUT = 65_536
_TOKENIZERS: dict = {}
#: How a byte-level vocabulary writes bytes: printable ones as themselves, the others from 256 on (fixed values).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Pair:
    """The two tokenizers, the bytes of their tokens, and texts of their ids."""

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_level) as f:
            vocabulary = json.load(f)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        byte_of = {chr(b): b for b in _PRINTABLE}
        byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())})
        entries = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        # merges rank as their results are numbered, so numbers serve as ranks
        self.a = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in entries.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as text of 8 bytes, each once as one of several in its group and once as the group's last of its side
        written = [f"{i}{s}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for s in ends]
        self.written = np.frombuffer(b"".join(w.ljust(8, b"\0") for w in written), dtype=np.uint64)


    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by both; None for an empty text and where the tokens' bytes are not the text's.

        A byte-level vocabulary spells all texts. Pieces spell what the model's rules leave as it is, their own mark of a
        space in a text apart.
        """
        if not text or "▁" in text:
            return None
        a, b = [], []
        for part in parts(" " + text):
            if self.b.normalize(part[1:]) != part.replace(" ", "▁"):
                return None
            a.append(np.array(self.a.encode_ordinary(part), dtype=np.int64))
            b.append(np.array(self.b.encode(part[1:]), dtype=np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        return (a, b) if self.a_sizes[a].sum() == self.b_sizes[b].sum() else None


#: Where a space follows something else: no token of either tokenizer goes over such a place.
_CUT = re.compile(r"(?<=\S)(?= )")


def parts(text: str, limit: int = SLICE) -> Iterator[str]:
    """Cut a long text at such places, so that little is held as Python numbers at once."""
    begin = 0
    while len(text) - begin > limit and (cut := _CUT.search(text, begin + limit)):
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


def tokenizers(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _TOKENIZERS:
        _TOKENIZERS[byte_level, pieces] = Pair(byte_level, pieces)
    return _TOKENIZERS[byte_level, pieces]


def gallop(x: np.ndarray, y: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and in ``y`` of the values that both rising lists hold."""
    if not len(x) or not len(y):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    far = np.iinfo(np.int64).max
    lanes = -(-len(x) // stretch)
    asked = np.full(lanes * stretch, far, dtype=np.int64)
    asked[:len(x)] = x
    asked = np.ascontiguousarray(asked.reshape(lanes, stretch).T)
    last, at = len(y) - 1, np.empty((stretch, lanes), dtype=np.int64)
    low = np.zeros(lanes, dtype=np.int64)  # all of y before it is smaller
    for k in range(stretch):
        value, width = asked[k], np.ones(lanes, dtype=np.int64)
        go = np.flatnonzero(y[np.minimum(low, last)] < value)
        while len(go):  # over what is too small, by ever longer steps
            low[go] += width[go]
            go = go[low[go] <= last]
            width[go] *= 2
            go = go[y[np.minimum(low[go] + width[go] - 1, last)] < value[go]]
        # the place is among the next `width`
        go = np.flatnonzero((width > 1) & (low <= last))
        size = np.minimum(width[go], last + 1 - low[go])
        while len(go):
            half = size // 2
            less = y[low[go] + half - 1 + (size == 0)] < value[go]
            low[go] += np.where(less, half, 0)
            size = np.where(less, size - half, half)
            more = size > 1
            go, size = go[more], size[more]
        ended = low <= last
        low[ended] += y[low[ended]] < value[ended]
        at[k] = low
    at = at.T.ravel()[:len(x)]
    found = np.flatnonzero(y[np.minimum(at, last)] == x)
    return found, at[found]


def common_ends(a_ends: list[np.ndarray], b_ends: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places in both lists of the ends that both hold. The shorter list of each text drives."""
    far, x, y, base = [], [], [], 0
    for a, b in zip(a_ends, b_ends, strict=True):
        swap = len(b) < len(a)
        far.append(swap)
        x.append((b if swap else a) + base)  # texts lie one after the other
        y.append((a if swap else b) + base)
        base += int(a[-1]) if len(a) else 0
    if not x:
        return []
    x_first, y_first = (np.cumsum([0, *map(len, side)]) for side in (x, y))
    in_x, in_y = gallop(np.concatenate(x), np.concatenate(y))
    cuts = np.searchsorted(in_x, x_first)
    out = []
    for i, swap in enumerate(far):
        one, two = in_x[cuts[i]:cuts[i + 1]] - x_first[i], in_y[cuts[i]:cuts[i + 1]] - y_first[i]
        out.append((two, one) if swap else (one, two))
    return out


def links(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a << 32 | b) of ids in the groups that end at these places, and how often each is linked."""
    a_n, b_n = np.diff(a_at, prepend=-1), np.diff(b_at, prepend=-1)
    b_first = b_at + 1 - b_n
    large = a_n * b_n > WRITTEN_OUT
    group = np.repeat(np.arange(len(a_n)), a_n)
    each = np.where(large, 0, b_n)[group]
    over = np.repeat(b_first[group] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    pairs, n = np.unique(np.repeat(a, each) << 32 | b[over], return_counts=True)
    if large.any():
        pairs, n = [pairs], [n]
        for g in np.flatnonzero(large):
            one, m = np.unique(a[a_at[g] + 1 - a_n[g]:a_at[g] + 1], return_counts=True)
            two, k = np.unique(b[b_first[g]:b_at[g] + 1], return_counts=True)
            pairs.append((one[:, None] << 32 | two).ravel())
            n.append((m[:, None] * k).ravel())
        pairs, place = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(n)).astype(np.int64)
    return pairs, n


def written(both: Pair, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> str:
    """SHA-256 of all groups as text."""
    a_n, b_n = np.diff(a_at, prepend=-1), np.diff(b_at, prepend=-1)
    groups = np.arange(len(a_at))
    one, two = np.repeat(groups, a_n), np.repeat(groups, b_n)
    code = np.empty(len(a) + len(b), dtype=np.int64)
    tail = np.zeros(len(a), dtype=np.int64)
    tail[a_at] = 1
    code[np.arange(len(a)) + (b_at + 1 - b_n)[one]] = 2 * a + tail
    tail = np.zeros(len(b), dtype=np.int64)
    tail[b_at] = 1
    code[np.arange(len(b)) + (a_at + 1)[two]] = 2 * (len(both.a_bytes) + b) + tail
    text = both.written[code].view(np.uint8)
    return hashlib.sha256(text[text != 0][:-1].tobytes()).hexdigest()


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by their bytes' places, after how many they are."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_DOCS = "array<struct<doc:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,sha:string,n_pairs:bigint>>"
_ARROW_DOCS = pa.list_(pa.struct([("doc", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("sha", pa.string()), ("n_pairs", pa.int64())]))


def aligned(both: Pair, docs: list, texts: list[str | None]) -> tuple[list[dict], list[np.ndarray], list[np.ndarray]]:
    """Figures of some texts, their distinct pairs, and how often each is linked."""
    ids = [both.ids(t) for t in texts]
    there = [x for x in ids if x is not None]
    at = iter(common_ends([np.cumsum(both.a_sizes[a]) for a, _ in there], [np.cumsum(both.b_sizes[b]) for _, b in there]))
    rows, pairs, counts = [], [], []
    for doc, x in zip(docs, ids, strict=True):
        if x is None:
            rows.append({"doc": doc, **dict.fromkeys(_FIGURES, 0), "sha": "", "n_pairs": 0})
            continue
        (a, b), (a_at, b_at) = x, next(at)
        p, n = links(a, b, a_at, b_at)
        rows.append({"doc": doc, "n_a": len(a), "n_b": len(b), "n_groups": len(a_at), "n_links": int(n.sum()), "sha": written(both, a, b, a_at, b_at), "n_pairs": len(p)})
        pairs.append(p)
        counts.append(n)
    return rows, pairs, counts


def shards(docs: DataFrame, byte_level: str, pieces: str, shard_bytes: int) -> DataFrame:
    """Some MB of documents a row: shard, docs (figures), places (of each document's pairs among the shard's), counts, pairs, holds."""

    def make(shard: int, rows: list[dict], pairs: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        none = [np.zeros(0, dtype=np.int64)]
        distinct, place = np.unique(np.concatenate(none + pairs), return_inverse=True)
        columns = [shard], [rows], [_squeeze(place)], [_squeeze(np.concatenate(none + counts))], [distinct], [np.bincount(place, minlength=len(distinct))]
        kinds = pa.int64(), _ARROW_DOCS, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "docs", "places", "counts", "pairs", "holds"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        first, k, held, size = TaskContext.get().partitionId() << 24, 0, ([], [], []), 0
        both = tokenizers(byte_level, pieces)
        for batch in batches:
            sizes = [x or 0 for x in batch.column("bytes").to_pylist()]
            for a, b in slices(sizes, SLICE):
                if held[0] and size + sum(sizes[a:b]) > shard_bytes:
                    yield make(first + k, *held)
                    k, held, size = k + 1, ([], [], []), 0
                for old, new in zip(held, aligned(both, batch.column("doc")[a:b].to_pylist(), batch.column("text")[a:b].to_pylist()), strict=True):
                    old += new
                size += sum(sizes[a:b]) + 64 * (b - a)
        if held[0]:
            yield make(first + k, *held)

    return docs.withColumn("bytes", F.octet_length("text")).mapInArrow(run, f"shard long, docs {_DOCS}, places binary, counts binary, pairs array<long>, holds array<long>")


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Align the tokens of a byte-level tokenizer (A, a json file) and a piece tokenizer (B, a model file).

    One row per row of ``docs``: doc_id, n_a and n_b (tokens of a space and the text), n_groups, n_links (pairs of A and B
    tokens whose byte ranges share a group), n_best (links whose pair of ids is held by as many documents as any of
    its A id), count_sum (documents that hold the pair, over all links), groups_sha256. A row counts as a document, so
    repeated rows count as often as they come, and a null id is as good as any. Null and empty texts, and those that
    the tokens do not spell byte by byte, have zeros and an empty digest. Other columns are not looked at, no rows give no rows.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    made = stored(shards(source, byte_level, pieces, shard_bytes))
    sent = made.select("shard", F.inline(F.arrays_zip("pairs", "holds")))
    total = sent.groupBy("pairs").agg(F.sum("holds").alias("total"))
    total = stored(total.withColumn("a", F.shiftright("pairs", 32)))
    highest = total.groupBy("a").agg(F.max("total").alias("highest"))
    # the total, and in its last bit whether it is the A id's highest
    marked = total.join(highest, "a").select("pairs", (F.col("total") * 2 + (F.col("total") == F.col("highest")).cast("long")).alias("marked"))
    given = release(stored(sent.select("shard", "pairs").join(marked, "pairs").select("shard", "pairs", "marked")))

    def read(mine: pa.Table, totals: pa.Table) -> pa.Table:
        marked = totals.sort_by("pairs").column("marked").to_numpy()
        out = []
        for docs_of, places, counts in zip(*(mine.column(c).to_pylist() for c in ("docs", "places", "counts")), strict=True):
            links_of = _unsqueeze(counts)
            held = marked[_unsqueeze(places)]
            sums = np.cumsum(np.concatenate([[0], links_of * (held >> 1)]))
            best = np.cumsum(np.concatenate([[0], links_of * (held & 1)]))
            at = np.cumsum([0, *(d["n_pairs"] for d in docs_of)])
            out += [(d["doc"], *(d[c] for c in _FIGURES), int(best[b] - best[a]), int(sums[b] - sums[a]), d["sha"]) for d, a, b in zip(docs_of, at[:-1], at[1:], strict=True)]
        names = ("doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256")
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table({c: pa.array(x, pa.string() if c == names[-1] else pa.int64()) for c, x in zip(names, columns, strict=True)})

    return made.select("shard", "docs", "places", "counts").groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(
        read, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
