"""Operator 10: log-probabilities of texts under a smoothed n-gram model, by a backoff automaton.

The automaton's states are the contexts of up to two words that the training texts have; an arc reads a word, a failure
arc takes the first word of the context away at a weight. Every text is read once from left to right: the state is carried,
failure arcs are followed until an arc for the word exists, and the logarithms add up. Many texts are read in step with each
other. Words that the training texts do not have are read at the bottom state. Counts are global and exact.

No task holds the model. Documents lie in shards of some MB, written once as token streams. A shard sends
its distinct keys with its counts to buckets of keys, a bucket adds them up over all shards, and each shard
gets the global counts of its own keys back. From these it builds the part of the automaton that its
documents can reach. What is gathered grows with the vocabulary and the n-grams of the corpus; a key that every shard has
costs one number per shard.

Smoothing: with c(h) the count of context h and P' the probability in the shorter context,
    P(w|h) = (c(hw) + mu P'(w)) / (c(h) + mu),
which sums to one: an arc where c(hw) > 0, else the failure arc's weight mu / (c(h) + mu) times P'(w). c(h) of a word is its
own count and c(h) of two words that of their 2-gram, so 2-grams and 3-grams are all that is counted besides words. An
n-gram's key is a hash of its words; a quarter of all keys is counted after the other, so that shuffle files of one are on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import SLICE, encoded, release, slices, stored
from sensorloom.llm.words import U, cut, mix

SHARD_BYTES, MU = 8_000_000, (400.0, 100.0)
#: Keys of n-grams are counted by their first two bits.
PARTS = 4
#: Long texts are read in stretches of so many tokens.
STRETCH = 1024
#: Hash of the end of a text, a token like any word.
END = U(0x5EED0F7E5EED0F7E)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    out, sizes = [], []
    for a, b in slices([len(t) for t in texts], SLICE):
        words = cut(texts[a:b])
        n = np.diff(words.first())
        stream = np.full(len(words.hashes) + b - a, END, dtype=U)
        stream[np.arange(len(words.hashes)) + words.text] = words.hashes
        out.append(stream)
        sizes.append(n + 1)
    return np.concatenate(out), np.concatenate(sizes)


def _squeeze(ids: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, their bytes by place."""
    return pa.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(blob, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Compressed 64-bit numbers, their bytes by place, after how many they are."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().view(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _packed(np.diff(keys.view(U), prepend=U(0)))


def _unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob).view(U), dtype=U).view(np.int64)


def _by_bucket(keys: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, list[dict]]:
    """Order of the keys by bucket, then value, and the rows to send."""
    bucket = (mix(keys.view(U) ^ U(0x1234567)) % U(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    which, begins = np.unique(bucket[order], return_index=True)
    ends = [*begins[1:], len(keys)]
    rows = [{"bucket": int(w), "keys": _packed_keys(keys[order[a:b]]), "counts": _packed(counts[order[a:b]])}
            for w, a, b in zip(which, begins, ends, strict=True)]
    return order, rows


_ROWS = "array<struct<bucket:int,keys:binary,counts:binary>>"
_ARROW_ROWS = pa.list_(pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))
_ARROW_DOCS = pa.list_(pa.struct([("doc", pa.int64()), ("held", pa.bool_()), ("n", pa.int64())]))


def shards(docs: DataFrame, buckets: int, shard_bytes: int) -> DataFrame:
    """Token streams of some MB of documents each: shard, docs, stream (places in the shard's words), words."""

    def make(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        ids, held, texts = zip(*rows, strict=True)
        stream, sizes = tokens(list(texts))
        words, place = np.unique(stream, return_inverse=True)
        learn = np.repeat(~np.array(held), sizes)
        order, sent = _by_bucket(words, np.bincount(place[learn], minlength=len(words)), buckets)
        at = np.empty(len(words), dtype=np.int64)
        at[order] = np.arange(len(words))
        listed = [{"doc": d, "held": h, "n": int(n)} for d, h, n in zip(ids, held, sizes, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([listed], _ARROW_DOCS), pa.array([_squeeze(at[place])], pa.binary()), pa.array([sent], _ARROW_ROWS)],
            names=["shard", "docs", "stream", "words"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        first, k, rows, size = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in batches:
            for row in zip(batch.column("doc").to_pylist(), batch.column("held").to_pylist(), encoded(batch.column("text")), strict=True):
                if rows and size + len(row[2]) > shard_bytes:
                    yield make(first + k, rows)
                    k, rows, size = k + 1, [], 0
                rows.append(row)
                size += len(row[2]) + 64
        if rows:
            yield make(first + k, rows)

    return docs.mapInArrow(run, f"shard long, docs array<struct<doc:bigint,held:boolean,n:bigint>>, stream binary, words {_ROWS}")


def totals(sent: DataFrame) -> DataFrame:
    """Counts summed over all shards, by bucket, and given back to each shard in the order of its keys.

    A bucket's first row also has the bucket's sum and its number of keys with a count.
    """

    def merge(table: pa.Table) -> pa.Table:
        keys = [_unpacked_keys(b) for b in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(b) for b in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        given = total[place]
        ends = np.cumsum([0, *map(len, keys)])
        others = [None] * (len(keys) - 1)
        return pa.table({
            "shard": table.column("shard"), "bucket": table.column("bucket"),
            "totals": pa.array([_packed(given[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            "n": pa.array([int(total.sum()), *others], pa.int64()), "seen": pa.array([int((total > 0).sum()), *others], pa.int64())})

    return sent.groupBy("bucket").applyInArrow(merge, "shard long, bucket int, totals binary, n long, seen long")


_SCORES = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
           ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))


def all_ngrams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 2-gram that ends at each token (the first one's begins with an end) and of the 3-grams after it.

    3-grams are those of all tokens but the first of each text, in order.
    """
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        before = np.concatenate([words[:1], words[:-1]])
        before[first] = END
        two = mix(mix(before) * U(3) + words)
        later = np.ones(len(words), dtype=bool)
        later[first] = False
        at = np.flatnonzero(later)
        return two, mix(two[at - 1] * U(5) + words[at] + U(1))


def part_keys(keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the keys of a part are, its distinct keys, rising, and the place of each among them."""
    at = np.flatnonzero(keys >> U(62) == U(part))
    return at, *np.unique(keys[at], return_inverse=True)


def part_rows(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[dict]:
    """Rows to send of a part's distinct keys: buckets are stretches of the keys, so order stays."""
    bucket = (keys << U(2) >> U(32)) * U(buckets) >> U(32)
    which, begins = np.unique(bucket, return_index=True)
    return [{"bucket": int(w), "keys": _packed_keys(keys[a:b]), "counts": _packed(counts[a:b])}
            for w, a, b in zip(which, begins, [*begins[1:], len(keys)][:len(begins)], strict=True)]


class Automaton:
    """The part of the backoff automaton that some texts can reach.

    State 0 has no context, 1 to ``words`` are single words, further ones the 2-grams in ``two``. What has no count is no
    state. Given are the counts of the words (``seen``), the number of the end of a text, the texts' tokens, and the counts
    of the 2-gram that ends at each token and, but for first tokens, of the 3-gram.
    """

    def __init__(self, seen: np.ndarray, end: int, ids: np.ndarray, sizes: np.ndarray, c2: np.ndarray, c3: np.ndarray, whole: float, mu=MU):
        v = self.words = len(seen)
        first = np.cumsum(sizes) - sizes
        last = np.concatenate([ids[:1], ids[:-1]])
        last[first] = end
        unigram = (seen + 0.5) / whole
        self.bottom = np.log10(unigram)
        self.known = np.where(seen > 0, np.arange(1, v + 1), 0)
        self.start = int(self.known[end])

        def after_one(at):
            return (c2[at] + mu[0] * unigram[ids[at]]) / (seen[last[at]] + mu[0])

        on = np.flatnonzero(c2 > 0)
        self.two, at, place = np.unique(last[on] * v + ids[on], return_index=True, return_inverse=True)
        at2 = on[at]
        pair = np.zeros(len(ids), dtype=np.int64)
        pair[on] = place
        counts = np.zeros(len(ids), dtype=np.int64)
        counts[np.delete(np.arange(len(ids)), first)] = c3
        on = np.flatnonzero(counts > 0)
        three, at = np.unique(pair[on - 1] * v + ids[on], return_index=True)
        at = on[at]
        after_two = (counts[at] + mu[1] * after_one(at)) / (c2[at - 1] + mu[1])
        # by length of context, the longer first: its lowest state less one, its arcs by state and word, their weights and ends
        self.levels = (
            (v, three, np.log10(after_two), 1 + v + pair[at]),
            (0, self.two, np.log10(after_one(at2)), 1 + v + np.arange(len(self.two))))
        self.fail = np.concatenate([np.zeros(v + 1, dtype=np.int64), 1 + self.two % v])
        self.weight = np.log10(np.concatenate([[1.0], mu[0] / (seen + mu[0]), mu[1] / (c2[at2] + mu[1])]))

    def context(self, state: int) -> tuple[int, ...]:
        """The words that a state stands for."""
        v = self.words
        return divmod(int(self.two[state - 1 - v]), v) if state > v else (state - 1,) if state else ()

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Let each state read its word: the states they lead to and the log10 probabilities."""
        state, to, log = state.copy(), np.zeros(len(state), dtype=np.int64), np.zeros(len(state))
        for low, arcs, weights, ends in self.levels:
            here = np.flatnonzero(state > low)
            if not len(here):
                continue
            key = (state[here] - 1 - low) * self.words + word[here]
            at = np.searchsorted(arcs, key)
            there = np.zeros(len(key), dtype=bool) if not len(arcs) else arcs[np.minimum(at, len(arcs) - 1)] == key
            taken, at = here[there], at[there]
            log[taken] += weights[at]
            to[taken] = ends[at]
            state[taken] = -1
            failed = here[~there]
            log[failed] += self.weight[state[failed]]
            state[failed] = self.fail[state[failed]]
        rest = np.flatnonzero(state == 0)
        log[rest] += self.bottom[word[rest]]
        to[rest] = self.known[word[rest]]
        return to, log

    def read(self, ids: np.ndarray, sizes: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """Log10 probability of each text.

        A text of more than ``stretch`` (at least two) tokens is read in stretches, in step with all others. A stretch
        starts two tokens early at the bottom: the state after two words is the same wherever one comes from.
        """
        pieces = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[text] + nth * stretch
        length = np.minimum(stretch, sizes[text] - nth * stretch) + 2 * (nth > 0)
        order = np.argsort(-length, kind="stable")
        text, length, early = text[order], length[order], 2 * (nth[order] > 0)
        at = begin[order] - early
        state = np.where(early > 0, 0, self.start)
        total = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t))
            state[:n], log = self.step(state[:n], ids[at[:n] + t])
            total[:n] += np.where(early[:n] <= t, log, 0.0)
        return np.bincount(text, weights=total, minlength=len(sizes))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", fold: int = 1, folds: int = 5, mu=MU, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Score every text with a model learned from the documents whose crc32(id) mod ``folds`` is not ``fold``.

    One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed
    unigram), score (log10 probability under the automaton). Tokens are the lower-cased (A-Z) words that white
    space parts, and one end; null and empty texts are an end alone. Rows without an id are learned from.
    Repeated rows count as often as they come. n-grams are over the whole vocabulary. Without any text to learn from, every
    token has its share of one unknown. Other columns are not read; without rows there are none in the result.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
    source = docs.select(F.col(key).cast("long").alias("doc"), held.alias("held"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(1, -(-((size[0] or 0) + 64 * size[1]) // shard_bytes))
    made = stored(shards(source, buckets, shard_bytes))
    words = stored(totals(made.select("shard", F.inline("words"))))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    whole = n + 0.5 * (v + 1)

    def streams(docs_of, blob, word_rows):
        held_out = np.array([d["held"] for d in docs_of])
        sizes = np.array([d["n"] for d in docs_of], dtype=np.int64)
        vocabulary = np.concatenate([_unpacked_keys(r["keys"]).view(U) for r in word_rows])
        return sizes, _unsqueeze(blob, int(sizes.sum())), vocabulary, np.repeat(~held_out, sizes)

    def of_part(part, sizes, ids, vocabulary, learn):
        at, keys, place = part_keys(np.concatenate(all_ngrams(vocabulary[ids], sizes)), part)
        learn = np.concatenate([learn, np.delete(learn, np.cumsum(sizes) - sizes)])[at]
        return part_rows(keys, np.bincount(place[learn], minlength=len(keys)), -(-buckets // PARTS))

    def count(part: int):
        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    shard, *row = (batch.column(c)[at].as_py() for c in ("shard", "docs", "stream", "words"))
                    rows = of_part(part, *streams(*row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in (("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))],
                        names=["shard", "bucket", "keys", "counts"])

        return totals(made.mapInArrow(run, "shard long, bucket int, keys binary, counts binary")).select("shard", "bucket", "totals")

    given = words.select("shard", F.lit(-1).alias("part"), "bucket", "totals")
    for part in range(PARTS):
        given = given.unionByName(release(stored(count(part).withColumn("part", F.lit(part)))))

    def read(mine: pa.Table, counts_of: pa.Table) -> pa.Table:
        out = []
        rows = sorted(counts_of.to_pylist(), key=lambda r: (r["part"], r["bucket"]))

        def got(part):
            return np.concatenate([np.zeros(0, np.int64), *(_unpacked(r["totals"]) for r in rows if r["part"] == part)])

        for row in mine.to_pylist():
            sizes, ids, vocabulary, _ = streams(row["docs"], row["stream"], row["words"])
            seen = got(-1)
            grams = np.concatenate(all_ngrams(vocabulary[ids], sizes))
            total = np.empty(len(grams), dtype=np.int64)
            for part in range(PARTS):
                at, _, place = part_keys(grams, part)
                total[at] = got(part)[place]
            del grams
            end = int(np.flatnonzero(vocabulary == END)[0])
            automaton = Automaton(seen, end, ids, sizes, total[:len(ids)], total[len(ids):], whole, mu)
            scores = automaton.read(ids, sizes)
            starts = np.cumsum(sizes) - sizes
            bases, known = np.add.reduceat(automaton.bottom[ids], starts), np.add.reduceat((seen[ids] > 0).astype(np.int64), starts)
            out.append(pa.table({
                "doc_id": pa.array([d["doc"] for d in row["docs"]], pa.int64()), "held_out": pa.array([d["held"] for d in row["docs"]], pa.bool_()),
                "n_tokens": sizes, "n_known": known, "train_tokens": pa.array([n] * len(sizes), pa.int64()), "base_score": bases, "score": scores}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in _SCORES})

    return made.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(
        read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
