"""Operator 12: near duplicates by an LSH forest.

A set of distinct 2-word shingles has a signature of minimum hashes. A tree of the forest is an order of all
signatures, each tree beginning with values of its own and going on with those of the next trees, so an order is as
deep as the signature is long. In an order a document is offered those neighbours within ``reach`` places whose
common prefix has at least ``depth`` values: a region of few documents is offered whole, in a crowded one only
the neighbours that share the longest prefixes meet. So the depth follows each region's density, and a document
makes at most ``reach`` candidates in a tree, however large its group is.

Trees are grown in rounds. A prefix whose documents are joined already has nothing to find and is left out, so later
rounds see only what is unsettled and can afford a wider reach. Candidates whose signatures agree too little
(five standard errors below the threshold) go; all others are decided on whole sets. Copies of one set are one node.

Orders are made by range partitioning with the node as last key, and cut into blocks of equal length with the
next block's first rows, so the size of a group of copies changes no task's share. A link of exactly the threshold
shares the first values in none of the trees with a chance of (1 - 0.8^4)^24, 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, release, slices, stored
from sensorloom.llm.jaccard import FILTER_BITS, components, shingle_sets
from sensorloom.llm.words import U, mix

K, PERCENT = 2, 80
#: Trees, and the values at the beginning of each that neighbours must share.
TREES, DEPTH = 24, 4
VALUES = TREES * DEPTH
#: First tree, tree after the last one, and reach of each round.
ROUNDS = ((0, 2, 4), (2, 8, 8), (8, TREES, 64))
#: Rows of an order that one group of a task holds.
BLOCK = 1024
#: Hashes that are held at once when minima are taken.
AT_ONCE = 65_536

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=U)) | U(1)
_MASKS = mix(np.arange(1, VALUES + 1, dtype=U) << U(32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of ``VALUES`` 32-bit minimum hashes, one for each of some non-empty sets."""
    out = np.empty((len(sets), VALUES), dtype=np.uint32)
    for a, b in slices([len(s) for s in sets], AT_ONCE):
        every = np.concatenate(sets[a:b])
        first = np.cumsum([0, *(len(s) for s in sets[a:b - 1])])
        with np.errstate(over="ignore"):
            for j in range(VALUES):
                out[a:b, j] = np.minimum.reduceat(((every ^ _MASKS[j]) * _FACTORS[j]) >> U(32), first)
    return out


def identity(s: np.ndarray) -> int:
    """64-bit hash of a set."""
    with np.errstate(over="ignore"):
        one, two = mix(s).sum(dtype=U), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
        return int(mix(np.array([mix(np.array([one]))[0] ^ (two + U(len(s)))]))[0].view(np.int64))


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """doc, n, node (hash of the set) and the signature as big-endian bytes, which sort like the values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, nodes, signed = [], [], []
        sizes = [len(x) if x else 0 for x in batch.column("text").to_pylist()]
        for a, b in slices(sizes, 4_000_000):
            sets = list(shingle_sets(batch.column("text").slice(a, b - a), k))
            full = [s for s in sets if len(s)]
            found = iter(signatures(full).astype(">u4")) if full else iter(())
            for s in sets:
                n.append(len(s))
                nodes.append(identity(s) if len(s) else None)
                signed.append(next(found).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signed, pa.binary())],
            names=["doc", "n", "node", "signature"])

    return arrow_rows(docs, "doc long, n long, node long, signature binary", run)


def _bit(name: str):
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))


def _bitmap(df: DataFrame, name: str) -> np.ndarray:
    """One bit per hashed value: ``FILTER_BITS`` / 64 rows reach the driver at most."""
    bit = _bit(name)
    words = df.select(F.shiftright(bit, 6).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.groupBy("place").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["place"]] = row["bits"]
    return out.view(U)


def _among(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    bit = batch.column("bit").to_numpy().astype(U)
    return batch.filter(pa.array((bitmap[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and set of the nodes whose smallest document is among ``wanted`` (doc); the texts are not shuffled."""
    bitmap = _bitmap(wanted, "doc")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for s in shingle_sets(_among(batch, bitmap).column("text"), k) if len(s)]
        return pa.RecordBatch.from_arrays(
            [pa.array([identity(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    rows = docs.where("doc IS NOT NULL").select("text", _bit("doc").alias("bit"))
    return arrow_rows(rows, "node long, set binary", run).groupBy("node").agg(F.first("set").alias("set"))


def _prefixes(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """tree, prefix (hash of the tree's first values), node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(-1, VALUES).astype(U)
        node, out = batch.column("node").to_numpy(), []
        with np.errstate(over="ignore"):
            for tree in range(first, last):
                prefix = np.full(len(node), tree + 1, dtype=U)
                for j in range(tree * DEPTH, (tree + 1) * DEPTH):
                    prefix = mix(prefix * U(0x9E3779B97F4A7C15) + values[:, j])
                out.append(prefix.view(np.int64))
        trees = np.repeat(np.arange(first, last, dtype=np.int32), len(node))
        return pa.RecordBatch.from_arrays([pa.array(trees), pa.array(np.concatenate(out)), pa.array(np.tile(node, last - first))], names=["tree", "prefix", "node"])

    return arrow_rows(nodes.select("node", "signature"), "tree int, prefix long, node long", run)


def _ordered(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (tree, node, label) with their signature from the tree's first value on, and their rank in all orders."""
    bitmap = _bitmap(members, "node")

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _among(batch, bitmap).drop_columns(["bit"])

    def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
        turned = [s[4 * DEPTH * t:] + s[:4 * DEPTH * t] for t, s in zip(batch.column("tree").to_pylist(), batch.column("signature").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "node", "label")), pa.array(turned, pa.binary())], names=["tree", "node", "label", "turned"])

    signed = arrow_rows(nodes.select("node", "signature", _bit("node").alias("bit")), "node long, signature binary", narrow)
    rows = arrow_rows(members.join(signed, "node").select("tree", "node", "label", "signature"), "tree int, node long, label long, turned binary", turn)
    keys = ("tree", "turned", "node")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    order = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    # one row per partition
    sizes = sorted((r["part"], r["n"]) for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    bases = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    base = order.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, bases, strict=False)], "part long, base long")
    return order.withColumn("part", part).join(base, "part").select("tree", "node", "label", "turned", (F.col("base") + place).alias("rank"))


def _offered(order: DataFrame, reach: int, percent: int) -> DataFrame:
    """Rows that are of a candidate pair: block, rank, node, label, and the ranks of later partners of the own block's rows."""
    least = VALUES * (percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / VALUES))
    own = F.floor(F.col("rank") / BLOCK)
    held = order.withColumn("block", F.explode(F.when(F.col("rank") % BLOCK < reach, F.array(own, own - 1)).otherwise(F.array(own))))

    def offer(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        block = table.column("block")[0].as_py()
        rank, label, tree = (table.column(c).to_numpy() for c in ("rank", "label", "tree"))
        values = np.frombuffer(b"".join(table.column("turned").to_pylist()), dtype=">u4").reshape(-1, VALUES).astype(np.uint32)
        mine = int(np.searchsorted(rank, (block + 1) * BLOCK))
        one, two = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for step in range(1, min(reach, len(rank) - 1) + 1):
            a = np.arange(min(mine, len(rank) - step))
            b = a + step
            a = a[(tree[a] == tree[b]) & (label[a] != label[b]) & (values[a, :DEPTH] == values[b, :DEPTH]).all(axis=1)]
            a = a[(values[a] == values[a + step]).sum(axis=1) >= least]
            one.append(a)
            two.append(a + step)
        one, two = np.concatenate(one), np.concatenate(two)
        partners = [[] for _ in rank]
        for a, b in zip(one.tolist(), rank[two].tolist(), strict=True):
            partners[a].append(b)
        at = pa.array(np.unique(np.concatenate([one, two])))
        return table.select(["block", "rank", "node", "label"]).append_column("partners", pa.array(partners, pa.list_(pa.int64()))).take(at)

    return held.groupBy("block").applyInArrow(offer, "block long, rank long, node long, label long, partners array<long>")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(offered: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the offered pairs by their whole sets; pairs that a block's links have joined are passed over."""

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rank, node, label = (table.column(c).to_pylist() for c in ("rank", "node", "label"))
        sets_of = [np.frombuffer(s, dtype=U) for s in table.column("set").to_pylist()]
        at, parent, links = {r: i for i, r in enumerate(rank)}, {x: x for x in label}, []

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, partners in enumerate(table.column("partners").to_pylist()):
            for j in [at[r] for r in partners if r in at]:
                a, b = top(label[i]), top(label[j])
                if a != b and similar(sets_of[i], sets_of[j], percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((node[i], node[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return offered.join(sets, "node").groupBy("block").applyInArrow(check, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of all nodes that are in a link."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    return components(stored(labels.unionByName(ends.select("node", F.col("node").alias("label")))), links)


def lsh_components(docs: DataFrame, k: int = K, percent: int = PERCENT, text: str = "text", key: str = "doc_id", salts: int = 16) -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles, component_id, kept, one row per row of ``docs``.

    Words are what white space parts, A-Z lower-cased; a set is the distinct k-word shingles, or all words as
    one for a shorter text. Two documents link when 100 * |both| >= percent * |either|; component_id is the smallest id
    that links reach and ``kept`` says that it is the row's own. Null, empty and wordless texts have no shingles, are their own
    component and kept. Rows without an id are linked with nothing, have a null component and are kept. Rows that
    share an id are one document, linked as any of them is; repeated rows are kept alike. Other columns are
    not looked at. No rows give no rows.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = stored(_rows(source, k))
    named = rows.where("n > 0 AND doc IS NOT NULL")
    nodes = release(stored(named.groupBy("node").agg(F.min("doc").alias("doc"), F.first("signature").alias("signature"))))
    # rows of one id with different texts
    same = named.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("doc", "a")
    same = stored(named.join(same, "doc").where("node != a").select("a", F.col("node").alias("b")).distinct())
    labels = _joined(docs.sparkSession.createDataFrame([], "node long, label long"), same)
    for first, last, reach in ROUNDS:
        placed = stored(_prefixes(nodes, first, last).join(labels, "node", "left").select("tree", "prefix", "node", F.coalesce("label", "node").alias("label")))
        open_ = placed.groupBy("tree", "prefix").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("tree", "prefix")
        members = stored(placed.join(open_, ["tree", "prefix"]).select("tree", "node", "label"))
        if members.isEmpty():
            continue
        offered = stored(_offered(_ordered(members, nodes), reach, percent))
        wanted = offered.select("node").distinct().join(nodes.select("node", "doc"), "node").select("doc")
        links = release(stored(_confirmed(offered, _sets_of(source, wanted, k), percent)))
        labels = release(_joined(labels, links))
    # one row of each class and node that is not alone; a node with very many rows meets them in several tasks
    copies = named.groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("rows"))
    classed = copies.join(labels, "node", "left").select("node", "doc", "rows", F.coalesce("label", "node").alias("label"))
    smallest = classed.groupBy("label").agg(F.min("doc").alias("component"))
    found = classed.join(smallest, "label").where("rows > 1 OR component != doc").select("node", "component")
    found = stored(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = rows.select("doc", "n", "node", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt")).join(found, ["node", "salt"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
