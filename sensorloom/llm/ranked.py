"""Operator 11: the best documents for each item by lexical score, documents grouped by which terms they hold.

Documents lie in shards of some MB, written once: each document's number of terms, and postings of the terms that any
item asks for. A bitmap of hashed terms, of fixed size, spares the others; what it lets through in vain is never asked
for. Counts of documents are summed over all shards, and give the weights of the items' terms.

In a shard an item's postings set one bit a term in the masks of its documents. Documents with one mask are a group, whose
score is at most the sum of its terms' largest contributions in the shard. Groups are scored exactly, highest limit first,
until the last place among the best is above the next group's limit. The best of all shards are ranked at the end.

Items are dealt to blocks of a bounded number of terms, and each block meets each shard once, by an equi join on
the block's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.llm.common import SLICE, arrow_rows, encoded, release, slices, stored
from sensorloom.llm.words import ALNUM, U, cut

BEST = 50
SHARD_BYTES = 16_000_000
#: Bits of the filter of asked terms.
FILTER_BITS = 1 << 23
#: Terms of the items of one block, all items together.
BLOCK_TERMS = 65_536


def items_of(items: DataFrame, text: str, key: str) -> DataFrame:
    """item and its distinct terms, one row a term."""
    kind = items.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = cut(encoded(batch.column("text")), ALNUM)
        return pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(words.text)), pa.array(words.hashes.view(np.int64))], names=["item", "term"])

    return arrow_rows(items.select(F.col(key).alias("item"), F.col(text).alias("text")), f"item {kind}, term long", run).distinct()


def _bit(name: str):
    return F.col(name).bitwiseAND(FILTER_BITS - 1)


def bitmap(terms: DataFrame) -> np.ndarray:
    """One bit per term hash: ``FILTER_BITS`` / 64 rows reach the driver at most."""
    bit = _bit("term")
    words = terms.select(F.shiftright(bit, 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.groupBy("place").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["place"]] = row["bits"]
    return out.view(U)


def postings(texts: list[bytes], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and the postings of asked terms: term, text, times."""
    words = cut(texts, ALNUM)
    bit = words.hashes & U(FILTER_BITS - 1)
    on = np.flatnonzero((asked[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1)
    term, place = np.unique(words.hashes[on].view(np.int64), return_inverse=True)
    code, times = np.unique(place * len(texts) + words.text[on], return_counts=True)
    return np.diff(words.first()), term[code // len(texts)], code % len(texts), times


_SHARD = "shard long, docs array<long>, sizes array<long>, terms array<long>, holds array<long>, at array<int>, times array<int>"


def shards(docs: DataFrame, asked: np.ndarray, shard_bytes: int) -> DataFrame:
    """shard, its docs and their sizes in terms, its asked terms, rising, how many docs hold each, and these with their times."""
    kinds = dict(docs=pa.int64(), sizes=pa.int64(), terms=pa.int64(), holds=pa.int64(), at=pa.int32(), times=pa.int32())

    def make(shard: int, docs: list, sizes: list, found: list) -> pa.RecordBatch:
        term, at, times = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [], [])))
        order = np.lexsort((at, term))
        terms, holds = np.unique(term, return_counts=True)
        columns = dict(docs=docs, sizes=np.concatenate(sizes), terms=terms, holds=holds, at=at[order].astype(np.int32), times=np.minimum(times[order], 2**31 - 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([columns[c]], pa.list_(k)) for c, k in kinds.items())], names=["shard", *kinds])

    def run(batches) -> Iterator[pa.RecordBatch]:
        first, k, docs, sizes, found, held = TaskContext.get().partitionId() << 24, 0, [], [], [], 0
        for batch in batches:
            texts = encoded(batch.column("text"))
            for a, b in slices([len(t) for t in texts], SLICE):
                more = sum(map(len, texts[a:b])) + 64 * (b - a)
                if docs and held + more > shard_bytes:
                    yield make(first + k, docs, sizes, found)
                    k, docs, sizes, found, held = k + 1, [], [], [], 0
                n, term, at, times = postings(texts[a:b], asked)
                found.append((term, at + len(docs), times))
                docs += batch.column("doc")[a:b].to_pylist()
                sizes.append(n)
                held += more
        if docs:
            yield make(first + k, docs, sizes, found)

    return docs.mapInArrow(run, _SHARD)


class Shard:
    """Postings of some documents, with what one holding of a term adds to a score of weight 1."""

    def __init__(self, docs: pa.Array, sizes: np.ndarray, terms: np.ndarray, holds: np.ndarray, at: np.ndarray, times: np.ndarray, n: int, length: int):
        self.order = docs.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)  # rows without an id come last
        self.terms, self.ends, self.at = terms, np.cumsum(holds), at
        m = 50 + 50 * sizes * n // max(length, 1)
        self.adds = 1_000_000_000 * times // (1000 * times + 20 * m[at])
        self.most = np.maximum.reduceat(self.adds, self.ends - holds) if len(terms) else self.adds

    def holding(self, place: int) -> slice:
        return slice(self.ends[place - 1] if place else 0, self.ends[place])

    def masks(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with any of the terms, the group of each, and which terms the groups hold (a row each)."""
        bits = np.zeros((len(self.order), -(-len(places) // 64)), dtype=U)
        for i, place in enumerate(places.tolist()):
            bits[self.at[self.holding(place)], i // 64] |= U(1) << U(i % 64)
        docs = np.flatnonzero(bits.any(axis=1))
        rows = np.ascontiguousarray(bits[docs])
        if rows.shape[1] > 1:
            rows = rows.view(np.dtype((np.void, 8 * rows.shape[1])))
        distinct, group = np.unique(rows.ravel(), return_inverse=True)
        held = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, bitorder="little")[:, :len(places)]
        return docs, group, held

    def scores(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, given in rising order."""
        out = np.zeros(len(docs), dtype=np.int64)
        for place, weight in zip(places.tolist(), weights.tolist(), strict=True):
            of = self.holding(place)
            at = np.minimum(np.searchsorted(self.at[of], docs), of.stop - of.start - 1)
            out += np.where(self.at[of][at] == docs, weight * self.adds[of][at], 0)
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``best`` documents for an item's terms with a score above 0, and their scores; evaluated group by group."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), dtype=bool)
        places, weights = place[there], weights[there]
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not len(places):
            return found, scores
        docs, group, held = self.masks(places)
        limit = held.astype(np.int64) @ (weights * self.most[places])
        order = np.argsort(-limit, kind="stable")
        sizes = np.bincount(group, minlength=len(limit))
        members, ends = docs[np.argsort(group, kind="stable")], np.cumsum(sizes)
        done, step, last = 0, best, 0
        while done < len(order) and (len(found) < best or limit[order[done]] >= last):
            upto = done + int(np.searchsorted(np.cumsum(sizes[order[done:]]), step)) + 1
            some = np.sort(np.concatenate([members[ends[g] - sizes[g]:ends[g]] for g in order[done:upto]]))
            found, scores = np.concatenate([found, some]), np.concatenate([scores, self.scores(some, places, weights)])
            first = np.lexsort((self.order[found], -scores))[:best]
            found, scores = found[first], scores[first]
            done, step, last = upto, 2 * step, int(scores[-1])
        above = scores > 0
        return found[above], scores[above]


def rank_documents(
    docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The ``best`` documents for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters outside ASCII, A-Z lower-cased. With N documents that have a term, L
    terms in all of them, n in one, df documents that hold a term and tf times in one: a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), m is 50 + 50 n N div L, and a score is the sum of weight *
    (10^9 tf div (1000 tf + 20 m)) over an item's terms, once each. Equal scores go by rising doc_id, none last. Only
    scores above 0 are listed. Null and empty texts have no terms. Rows of items that share an id (or have none) are one
    item with the terms of all. Repeated documents are ranked one after the other. Other columns are not looked at. No
    items or no documents give no rows.
    """
    asked = stored(items_of(items, item_text, item_key))
    kind = asked.schema["item"].dataType.simpleString()
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    made = stored(shards(source, bitmap(asked.select("term").distinct()), shard_bytes))
    n, length = made.agg(
        F.sum(F.size(F.filter("sizes", lambda x: x > 0)).cast("long")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, length = n or 0, length or 0
    df = made.select(F.inline(F.arrays_zip("terms", "holds"))).groupBy("terms").agg(F.sum("holds").alias("df"))
    weight = F.floor(1000 * F.log((2 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df.withColumnRenamed("terms", "term"), "term").select("item", F.struct("term", weight.alias("weight")).alias("term"))
    listed = weighted.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    blocks = -(-asked.count() // BLOCK_TERMS)
    listed = listed.select(F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))).alias("block"), F.struct("item", "terms").alias("item"))
    dealt = release(stored(listed.groupBy("block").agg(F.collect_list("item").alias("items"))))

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in range(batch.num_rows):
            shard = batch.slice(row, 1)
            arrays = {c: shard.column(c).flatten() for c in ("docs", "sizes", "terms", "holds", "at", "times")}
            own = Shard(arrays["docs"], *(arrays[c].to_numpy().astype(np.int64) for c in ("sizes", "terms", "holds", "at", "times")), n, length)
            wanted = shard.column("items").flatten()
            ids, terms = wanted.field("item"), wanted.field("terms")
            for i in range(len(wanted)):
                pairs = terms[i].values
                found, scores = own.best(pairs.field("term").to_numpy(), pairs.field("weight").to_numpy(), best)
                if len(found):
                    out.append(pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(found))), arrays["docs"].take(pa.array(found)), pa.array(scores)], names=["item_id", "doc_id", "score"]))
        whole = pa.Table.from_batches(out).combine_chunks() if out else None
        if whole is None:
            return pa.RecordBatch.from_arrays([pa.array([], batch.schema.field("items").type.value_type.field("item").type), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["item_id", "doc_id", "score"])
        return whole.to_batches()[0]

    met = made.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long")))).join(dealt, "block")
    found = arrow_rows(met.select("docs", "sizes", "terms", "holds", "at", "times", "items"), f"item_id {kind}, doc_id long, score long", search)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
