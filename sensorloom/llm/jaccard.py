"""Operator 4: all links between documents whose shingle sets are similar, as a metric-space join.

Jaccard distance is a metric. Two unrelated texts are at distance 1 from each other and from any pivot, so
pivots drawn from the corpus alone would put nearly all of it into one region. The first regions are
therefore those of one-shingle pivots: a set that lies within the radius of another shares one of the first
``n - ceil(0.8 n) + 1`` of its shingles with it, in any order that all sets use, so a document is
replicated to those pivots. The order takes very frequent shingles last, which only saves work. A region is then
cut by the sets' sizes, which differ by a fifth at most within the radius.

A pair belongs to the region of its first common shingle. There the places p of that shingle in both sets bound what they
can share to min(n - p), so the smaller set of a link has it among its first ninth: only such members are pivots,
pairs whose places leave too little are not compared, and a region without such a member is none. Texts that share a
long passage but are not similar meet behind their own rare shingles, and so are never compared.

Inside a region, document pivots are compared with all members. Members go to the Voronoi cell of their
nearest pivot and, by the triangle inequality, to every cell whose pivot is at most twice the radius
farther: two documents within the radius of each other then meet in a cell. Cells are regions of the next
round, with more pivots each, unless splitting would only replicate. Members that links have already
joined need no more comparison, so a region ends once it holds one component; copies of one set are one
member. Only pairs of a pivot and a member are ever made, never all pairs of a group. Short vectors
of shingle counts bound distances from below and spare most pairs the sets; every link is decided by exact
counts.

Tables of shingles are as large as the texts. Each is deleted once the next is made of it, regions are found and sets
compared in ``SLICES`` turns whose shuffles are not on disk together, and whole sets are made of open pairs only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.llm.common import arrow_rows, discard, give_back, release, stored, text_slices
from sensorloom.llm.words import U, cut, mix, sequence_hash

K, PERCENT = 5, 80
#: A number above all places of a set, to hold two in one long.
_PLACE = 1 << 31
#: How many very frequent shingles are ordered last at most, from how many of those counted together on, and how many of these.
FREQUENT, FREQUENT_FROM, FREQUENT_PER_BATCH = 200_000, 3, 65_536
#: Shingles that are counted together.
FREQUENT_OF = 3_000_000
#: Places of the count vectors: the sum of their differences is at most the number of shingles in one set only.
PLACES = 256
#: Bits of the filter that spares texts of no region their second reading; what it lets through in vain only costs.
FILTER_BITS = 1 << 23
#: Turns in which regions are found and sets compared.
SLICES = 3
#: Rounds whose pairs alone get sets; those of later rounds find the sets of all members left, who are few by then.
PAIRED_ROUNDS = 2
#: Regions of fewer members are not worth cells of their own: their pivots are soon all used.
SPLIT_FROM = 64
#: Pivots of a region that span cells; regions with more of them are not split any further.
CELL_PIVOTS = 16


def shingle_sets(column: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as rising hashes; a shorter text is one shingle."""
    for texts in text_slices(column):
        words = cut(texts)
        text, hashes = words.shingles(k)
        first, bounds = words.first(), np.searchsorted(text, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if first[i] == first[i + 1]:
                yield np.zeros(0, dtype=U)
            elif bounds[i] == bounds[i + 1]:
                yield sequence_hash(words.hashes[first[i]:first[i + 1]])
            else:
                yield np.unique(hashes[bounds[i]:bounds[i + 1]])


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that many documents share: at most ``FREQUENT``, rising. They only order prefixes."""

    def count(every: np.ndarray) -> pa.RecordBatch:
        # of the sorted shingles only those that stand FREQUENT_FROM times in a row are looked at any more
        every.sort()
        reach = FREQUENT_FROM - 1
        values, n = np.unique(every[reach:][every[reach:] == every[:len(every) - reach]], return_counts=True)
        n = n + reach
        often = np.argsort(-n, kind="stable")[:FREQUENT_PER_BATCH]
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["s", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(FREQUENT_OF, dtype=U), 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), k):
                if size + len(s) > FREQUENT_OF:
                    yield count(held[:size])
                    size = 0
                if len(s) > FREQUENT_OF:
                    continue  # distinct shingles of one text: none stands there twice
                held[size:size + len(s)] = s
                size += len(s)
        yield count(held[:size])
        give_back()

    top = docs.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT)
    return np.sort(np.array([r["s"] for r in top.collect()], dtype=np.int64).view(U))


def _sets(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc, n, two hashes of the whole set, its prefix in the common order, and how many shingles fall on each of ``PLACES`` places (127 at most)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for s in shingle_sets(batch.column("text"), k):
            n = len(s)
            if not n:
                rows.append((0, 0, 0, s.view(np.int64), np.zeros(PLACES, dtype=np.int8)))
                continue
            with np.errstate(over="ignore"):
                one, two = mix(s).sum(), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum()
            late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(n, dtype=bool)
            prefix = np.concatenate([s[~late], s[late]])[:n - -(-percent * n // 100) + 1]
            counts = np.minimum(np.bincount((s % U(PLACES)).astype(np.int64), minlength=PLACES), 127).astype(np.int8)
            rows.append((n, int(one.view(np.int64)), int(two.view(np.int64)), prefix.view(np.int64), counts))
        n, one, two, prefix, counts = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, prefix)])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(prefix))).cast(pa.list_(pa.int64())),
             pa.array(counts, pa.list_(pa.int8()))],
            names=["doc", "n", "one", "two", "prefix", "counts"])

    return arrow_rows(docs, "doc long, n long, one long, two long, prefix array<long>, counts array<tinyint>", run)


def _bit(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))


def _filter(ids: DataFrame) -> np.ndarray:
    """One bit per hashed node. At most FILTER_BITS / 64 rows reach the driver, whatever the number of nodes."""
    bit = _bit("node")
    parts = ids.select((F.shiftright(bit, 6)).alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in parts.groupBy("place").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["place"]] = row["bits"]
    return out.view(U)


def _hits(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.Array:
    bit = batch.column("bit").to_numpy().astype(U)
    return pa.array((wanted[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1)


def _marked(whole: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of ``whole`` with ``copied``: false where no other row has their set, for sure; the sets of ``copies`` all have it true."""
    name = F.xxhash64("n", "one", "two").alias("node")
    wanted = _filter(copies.select(name))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("copied", _hits(batch, wanted)).drop_columns(["bit"])

    rows = whole.select("*", name).withColumn("bit", _bit("node")).drop("node")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return arrow_rows(rows, f"{kinds}, copied boolean", run)


def _full_sets(docs: DataFrame, wanted: np.ndarray, k: int) -> DataFrame:
    """node and its set, of all documents whose bit is ``wanted``; the text is not shuffled."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(_hits(batch, wanted))
        sets = pa.array([s.view(np.int64) for s in shingle_sets(batch.column("text"), k)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "set"])

    rows = docs.where("doc IS NOT NULL").select(F.col("doc").alias("node"), "text", _bit("doc").alias("bit"))
    return arrow_rows(rows, "node long, set array<long>", run)


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components that links join: ``labels`` (node, label), ``links`` (a, b of nodes).

    The label is the smallest node. Every component hooks to its smallest neighbour and skips one step on;
    the graph of components shrinks by at least half a round.
    """
    on = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    edges = stored(
        links.join(on("a"), "a").join(on("b"), "b")
        .select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        .where("a < b").distinct()
    )
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hook = stored(
            hook.join(hook.select(F.col("a").alias("to"), F.col("to").alias("next")), "to")
            .select("a", F.least("to", "next").alias("to"))
        )
        labels = stored(labels.join(hook.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        moved = edges.join(hook, "a").select("b", F.col("to").alias("a")).join(hook.withColumnRenamed("a", "b"), "b").select("a", F.col("to").alias("b"))
        edges = stored(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def _bounds(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lower bounds of the distances of pairs (a, b), and whether they leave a link possible (``open``)."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("counts").alias("a_counts"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("counts").alias("b_counts"))
    apart = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda t, x: t + x)
    apart, total = F.greatest(apart.cast("long"), F.abs(F.col("a_n") - F.col("b_n"))), F.col("a_n") + F.col("b_n")
    # rows that share an id are one node: its nearest row counts
    return pairs.join(one, "a").join(two, "b").select("a", "b", apart.alias("apart"), total.alias("total")).groupBy("a", "b").agg(
        F.min(2 * F.col("apart") / (F.col("total") + F.col("apart"))).alias("least"),
        F.max(F.col("apart") * (100 + percent) <= F.col("total") * (100 - percent)).alias("open"))


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact distances of pairs (a, b), and whether they link, from their whole sets."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = sets.select("node", "set").join(wanted, "node", "left_semi")
    one, two = (held.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set")) for x in "ab")
    both, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    return pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), total.alias("total")).groupBy("a", "b").agg(
        F.min(1 - F.col("both") / (F.col("total") - F.col("both"))).alias("exact"),
        F.max(F.col("both") * 100 >= F.lit(percent) * (F.col("total") - F.col("both"))).alias("link"))


def _sliced_distances(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """As ``_distances``, with sets that are made of the pairs' nodes alone and go when all pairs have been compared."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = release(stored(_full_sets(docs, _filter(wanted), k)))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(SLICES))
    turns = [release(stored(_distances(pairs.where(turn == i), sets, percent))) for i in range(SLICES)]
    discard(sets)
    return reduce(DataFrame.unionByName, turns)


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For every document the size of its shingle set and the smallest id it is linked with.

    Words are what white space parts, A-Z lower-cased; a set is the distinct k-word shingles, or all words as
    one for a shorter text. Two documents link when 100 * |both| >= percent * |either|. Returns one row per row
    of ``docs``: doc_id, n_shingles, component_id. Null, empty and wordless texts have an empty set and are
    their own component. Rows without an id are linked with nothing and have a null component. Rows that
    share an id are one document: each is linked as any of them is.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    whole = stored(_sets(source, k, percent, frequent_shingles(source, k)))
    rows = stored(whole.select("doc", "n", "one", "two"))
    named = rows.where("n > 0 AND doc IS NOT NULL")
    # copies of one set are one node; only sets that have some are shuffled
    marked = stored(_marked(whole.where("n > 0 AND doc IS NOT NULL"), named.groupBy("n", "one", "two").count().where("count > 1")))
    discard(whole)
    several = stored(marked.where("copied").groupBy("n", "one", "two").agg(F.min("doc").alias("node"), F.first("prefix").alias("prefix")).select("node", "n", "prefix"))
    nodes = marked.where("NOT copied").select(F.col("doc").alias("node"), "n", "prefix").unionByName(several)
    shared = nodes.select("node", F.posexplode("prefix").alias("pos", "region"), "n").select("region", "node", (F.col("n") * _PLACE + F.col("pos")).alias("at"))
    # a link's smaller set has the first common shingle among its first ninth (at 80 percent)
    leads = F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)
    n, pos = F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND(_PLACE - 1).alias("pos")
    # sets within the radius differ in size by one step of this scale at most; a cell holds two steps
    step = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent)))
    cell = F.explode(F.array(step, step - 1)).alias("cell")
    turns = []
    for turn in range(SLICES):
        part = shared.where(F.pmod("region", F.lit(SLICES)) == turn)
        # nodes and, above them, leading nodes of a region, in one number
        regions = part.select("region", n, pos).select("region", F.when(leads, F.lit(_PLACE + 1)).otherwise(F.lit(1)).alias("one")).groupBy("region").agg(F.sum("one").alias("sum"))
        regions = release(stored(regions.where(f"sum > {_PLACE} AND sum % {_PLACE} > 1").select("region")))
        sized = part.join(regions, "region").select("region", "node", n, pos).select("region", "node", "n", "pos", leads.alias("leads"), cell)
        sized = sized.select(F.xxhash64("region", "cell").alias("region"), "node", "n", "pos", "leads")
        turns.append(release(stored(sized.groupBy("region", "node").agg(F.min(F.struct("pos", "n", "leads")).alias("m")).select("region", "node", "m.n", "m.pos", "m.leads"))))
        discard(regions)
    sized = reduce(DataFrame.unionByName, turns)
    counted = release(stored(marked.select(F.col("doc").alias("node"), "n", "counts")))
    discard(marked, several)
    members = stored(_unsettled(sized.withColumn("label", F.col("node"))))
    ids = members.select("node").distinct()
    labels = stored(ids.withColumn("label", F.col("node")))
    counts = release(stored(counted.join(ids, "node", "left_semi")))
    discard(counted, *turns)
    pivots, rounds, sets = 1, 0, None
    while not members.isEmpty():
        turn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(pivots))
        chosen = members.where("leads").groupBy("region", turn.alias("turn")).agg(F.min(F.struct(F.xxhash64("node"), "node", "label", "n", "pos")).alias("p"))
        chosen = chosen.select("region", F.col("p.node").alias("pivot"), F.col("p.label").alias("pivot_label"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos"))
        chosen = stored(chosen)
        # what two sets share is at most what both have from the region's shingle on
        both = F.least(F.col("n") - F.col("pos"), F.col("pivot_n") - F.col("pivot_pos"))
        near = members.join(chosen, "region").where((F.col("label") != F.col("pivot_label")) & (both * (100 + percent) >= percent * (F.col("n") + F.col("pivot_n"))))
        near = stored(near.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
        bounds = stored(_bounds(near, counts, percent))
        opened, rounds = bounds.where("open").select("a", "b"), rounds + 1
        if rounds <= PAIRED_ROUNDS:
            exact = _sliced_distances(opened, source, k, percent)
        else:
            sets = release(stored(_full_sets(source, _filter(members.select("node").distinct()), k))) if sets is None else sets
            exact = release(stored(_distances(opened, sets, percent)))
        labels = components(labels, exact.where("link").select("a", "b"))
        faced = known = None
        if 1 < pivots <= CELL_PIVOTS:
            parting = stored(_parting(members, chosen, exact, percent))
            if not parting.isEmpty():
                faced = stored(members.join(parting, "region").join(chosen, "region").withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}))
                more = faced.where("label != pivot_label").select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
                known = bounds.unionByName(_bounds(more, counts, percent)).join(exact.drop("link"), ["a", "b"], "left")
        members = release(_next_regions(members, chosen, faced, known, labels, percent))
        pivots *= 4 if pivots < CELL_PIVOTS else 8
    discard(counts, *([] if sets is None else [sets]))
    found = named.groupBy("n", "one", "two").agg(F.min("doc").alias("node")).join(labels, "node", "left").select("n", "one", "two", F.coalesce("label", "node").alias("label"))
    return (
        rows.select("doc", "n", "one", "two").join(found, ["n", "one", "two"], "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                F.when(F.col("doc").isNotNull(), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("label"))).alias("component_id"))
    )


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of the regions that hold a pivot to come and more than one component, one region of each member set.

    Near copies share many shingles and so meet in many regions with the very same members. The first of them in the order
    of shingles has all of their pairs. Member sets are told apart by their size and two 64-bit hashes.
    """
    held = members.groupBy("region").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.max("leads").alias("led"), F.count("*").alias("size"), F.sum("pos").alias("place"),
        F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two")).where("least < most AND led")
    kept = held.groupBy("size", "one", "two").agg(F.min(F.struct("place", "region")).alias("first")).select("first.region")
    return members.join(kept, "region")


def _parting(members: DataFrame, chosen: DataFrame, exact: DataFrame, percent: int) -> DataFrame:
    """Large regions that cells may part: nearly all of their members are known to be near a pivot.

    A member that is not is in the cell of every pivot, for no distance is above 1. Where these alone make the cells
    hold over 1.5 times the region's rows, no member needs to face all pivots to tell that the region stays whole.
    """
    close = exact.where(F.col("exact") + 2 * (1 - percent / 100) + 1e-9 < 1)
    close = stored(close.select(F.inline(F.array(*(F.struct(F.col(x).alias("pivot"), F.col(y).alias("node")) for x, y in ("ab", "ba"))))))
    parts = lambda placed: (placed + (F.col("size") - placed) * F.col("pivots")) <= 1.5 * F.col("size")
    large = members.groupBy("region").agg(F.count("*").alias("size")).where(F.col("size") >= SPLIT_FROM)
    own = chosen.select("region", "pivot").join(large, "region")
    # a pivot places itself and at most all that it is close to, in whatever region
    reach = own.join(close.groupBy("pivot").agg(F.count("*").alias("reach")), "pivot", "left").withColumn("reach", F.coalesce("reach", F.lit(0)) + 1)
    held = reach.groupBy("region").agg(F.first("size").alias("size"), F.count("*").alias("pivots"), F.sum("reach").alias("reach"))
    held = stored(held.where(parts(F.col("reach"))).drop("reach"))
    own = chosen.select("region", "pivot").join(held, "region")
    placed = own.join(close, "pivot").select("region", "node").join(members, ["region", "node"], "left_semi")
    placed = placed.unionByName(own.select("region", F.col("pivot").alias("node"))).distinct().groupBy("region").agg(F.count("*").alias("placed"))
    return held.join(placed, "region").where(parts(F.col("placed"))).select("region")


def _next_regions(members: DataFrame, chosen: DataFrame, faced: DataFrame | None, known: DataFrame | None, labels: DataFrame, percent: int) -> DataFrame:
    """Regions that still hold more than one component, without the pivots all their members have met.

    ``faced``: members of regions that cells may part with all of their pivots. Where a distance is only bounded, the cells
    are those that the bounds allow.
    """
    places = members.select("region", "node", "n", "pos", "leads")
    left = members.select(F.col("region").alias("cell"), "region", "node")
    if faced is not None:
        radius = 1 - percent / 100
        own = F.col("node") == F.col("pivot")
        low = F.when(own, 0.0).otherwise(F.coalesce("exact", "least", F.lit(0.0)))
        high = F.when(own, 0.0).otherwise(F.coalesce("exact", F.lit(1.0)))
        measured = stored(faced.join(known, ["a", "b"], "left").select("region", "node", "pivot", low.alias("low"), high.alias("high")))
        nearest = measured.groupBy("region", "node").agg(F.min("high").alias("near"))
        cells = measured.join(nearest, ["region", "node"]).where(F.col("low") <= F.col("near") + 2 * radius + 1e-9)
        # splitting must not only replicate: a region stays whole where its cells hold over 1.5 times its rows
        size = cells.groupBy("region").agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes"))
        split = stored(size.where("rows <= 1.5 * nodes").select("region"))
        left = left.join(split, "region", "left_anti").unionByName(
            cells.join(split, "region").select(F.xxhash64("region", "pivot").alias("cell"), "region", "node"))
    met = chosen.select("region", F.col("pivot").alias("node")).distinct()
    left = left.join(met, ["region", "node"], "left_anti").join(places, ["region", "node"])
    left = left.select(F.col("cell").alias("region"), "node", "n", "pos", "leads").join(labels, "node")
    return stored(_unsettled(stored(left)).select("region", "node", "label", "n", "pos", "leads"))
