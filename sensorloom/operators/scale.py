"""Building blocks that keep long series off single tasks.

A network has few sites and long series, so ``Window.partitionBy(site)`` puts a third of the data
in one task. Everything here splits a series along its own order instead:

* ``framed``    bounded frames. A series is cut into blocks, each block also receives the few
                neighbouring rows its frames reach into (a halo), and copies are dropped afterwards.
* ``prefix``    unbounded frames (running totals, last known value, previous row). Each chunk is
                folded to one row, the chunk rows are scanned per key, and the result is added to
                the window inside the chunk.
* ``quantiles`` exact percentiles of a hot key without a per-key value map.
* ``period_join`` interval joins as equi joins on time buckets.

All four are plain DataFrame plans, deterministic, and give what the one-task window would give.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

Frame = Callable[[WindowSpec], Column]


def spread(df: DataFrame, order: str, before: int, after: int, block: int) -> DataFrame:
    """Rows with their ``_home`` block and one copy for each ``_block`` whose frames reach them."""
    size = max(block, before, after, 1)
    at = F.col(order)
    offset = at - F.col("_home") * size
    copies = F.array_compact(
        F.array(
            F.col("_home"),
            *([F.when(offset >= size - before, F.col("_home") + 1)] if before else []),
            *([F.when(offset < after, F.col("_home") - 1)] if after else []),
        )
    )
    return df.withColumn("_home", F.floor(at / F.lit(size))).withColumn("_block", F.explode(copies))


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    stages: Mapping[str, Frame] | Sequence[Mapping[str, Frame]],
    before: int = 0,
    after: int = 0,
    block: int = 2048,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` units of ``order``.

    ``order`` is a BIGINT. Frames may be ROWS frames when ``order`` counts rows or grid steps one by
    one, or RANGE frames over any integer clock. Later stages may read the columns of earlier ones;
    ``before`` and ``after`` cover the sum of their reaches.
    """
    stages = [stages] if isinstance(stages, Mapping) else list(stages)
    w = Window.partitionBy(*keys, "_block").orderBy(order, *tie)
    out = spread(df, order, before, after, block)
    for stage in stages:
        out = out.withColumns({name: make(w) for name, make in stage.items()})
    return out.where("_block = _home").drop("_home", "_block")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    running: Mapping[str, tuple[str, Column]],
    size: int = 2048,
    tie: Sequence[str] = (),
    reverse: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add columns running from the start of each series (from its end when ``reverse``).

    ``running`` maps a name to (kind, expression). Kinds: ``sum``, ``min``, ``max`` and ``last``
    (last non-null) include the current row; ``prev`` is the expression on the row before;
    ``before`` is the last non-null value strictly before the row.

    The chunk rows come from ``source`` where given: the stored frame ``df`` grew from, with the same
    rows. A chain of calls then reads the stored frame once per link and never reruns the chain.
    """
    out = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)))
    sort = [F.col(c).desc() if reverse else F.col(c) for c in (order, *tie)]
    w = Window.partitionBy(*keys, "_chunk").orderBy(*sort)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    chunk_order = F.col("_chunk").desc() if reverse else F.col("_chunk")
    across = (
        Window.partitionBy(*keys)
        .orderBy(chunk_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    latest = F.min_by if reverse else F.max_by
    place = F.struct(order, *tie)

    local, fold, carry, merge = {}, {}, {}, {}
    for name, (kind, value) in running.items():
        mine, chunk = f"_in_{name}", f"_all_{name}"
        if kind in ("sum", "min", "max"):
            reduce = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
            local[mine] = reduce(value).over(upto)
            fold[chunk] = reduce(value)
            carry[chunk] = reduce(chunk).over(across)
            if kind == "sum":
                zero = F.lit(0)
                merge[name] = F.coalesce(F.col(chunk), zero) + F.coalesce(F.col(mine), zero)
            else:
                pick = F.least if kind == "min" else F.greatest
                merge[name] = pick(F.col(mine), F.col(chunk))
        elif kind in ("last", "before"):
            local[mine] = F.last(value, ignorenulls=True).over(upto if kind == "last" else earlier)
            fold[chunk] = latest(value, F.when(value.isNotNull(), place))
            carry[chunk] = F.last(chunk, ignorenulls=True).over(across)
            merge[name] = F.coalesce(F.col(mine), F.col(chunk))
        elif kind == "prev":
            boxed = F.struct(value.alias("v"))
            local[mine] = F.lag(boxed).over(w)
            fold[chunk] = latest(boxed, place)
            carry[chunk] = F.last(chunk, ignorenulls=True).over(across)
            merge[name] = F.coalesce(F.col(mine), F.col(chunk))["v"]
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    base = df if source is None else source
    chunks = (
        base.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)))
        .groupBy(*keys, "_chunk")
        .agg(*[c.alias(n) for n, c in fold.items()])
        .select(*keys, "_chunk", *[c.alias(n) for n, c in carry.items()])
    )
    out = out.withColumns(local).join(chunks, [*keys, "_chunk"])
    return out.withColumns(merge).drop("_chunk", *local, *fold)


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "n",
    size: int = 2048, tie: Sequence[str] = (),
) -> DataFrame:
    """A 0-based BIGINT row number per key, for ROWS frames over irregular series."""
    counted = prefix(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, size, tie)
    return counted.withColumn(name, F.col(name) - 1)


def runs(
    df: DataFrame, keys: Sequence[str], order: str, breaks: Callable[[Column, Column], Column],
    name: str = "run", size: int = 2048, tie: Sequence[str] = (), also: str | None = None,
    start: str | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Number the stretches of rows between breaks, from 1; ``start`` names each row's stretch opening.

    ``breaks(previous, current)`` compares ``also`` (default ``order``) on neighbouring rows, and a
    NULL answer breaks; the first row always opens a run. Breaks inside a chunk need only the chunk;
    whether a chunk's first row opens one is settled on the chunk rows.
    """
    what, place = F.col(also or order), F.struct(order, *tie)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order, *tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(breaks(F.col("_back.v"), what), F.lit(True))


    def opened(frame: DataFrame) -> DataFrame:
        return (
            frame.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)))
            .withColumn("_back", F.lag(F.struct(what.alias("v"))).over(w))
            .withColumn("_inner", F.when(F.col("_back").isNotNull() & cut, 1).otherwise(0).cast("bigint"))
        )

    local = opened(df).withColumns({
        "_n": F.sum("_inner").over(upto),
        "_s": F.last(F.when(F.col("_inner") == 1, F.col(order)), ignorenulls=True).over(upto),
    })
    joins = (
        opened(df if source is None else source).groupBy(*keys, "_chunk")
        .agg(
            F.min_by(F.struct(what.alias("v")), place).alias("_head"),
            F.max_by(F.struct(what.alias("v")), place).alias("_tail"),
            F.min(order).alias("_lead"),
            F.sum("_inner").alias("_opened"),
            F.max(F.when(F.col("_inner") == 1, F.col(order))).alias("_latest"),
        )
        .withColumn("_was", F.lag("_tail").over(across))
        .withColumn(
            "_first",
            F.when(
                F.col("_was").isNull()
                | F.coalesce(breaks(F.col("_was.v"), F.col("_head.v")), F.lit(True)),
                1,
            ).otherwise(0).cast("bigint"),
        )
        .withColumn("_own", F.when(F.col("_first") == 1, F.col("_lead")))
        .select(
            *keys, "_chunk", "_first", "_own",
            F.coalesce(F.sum(F.col("_first") + F.col("_opened")).over(earlier), F.lit(0)).alias("_runs"),
            F.last(F.coalesce("_latest", "_own"), ignorenulls=True).over(earlier).alias("_from"),
        )
    )
    out = local.join(joins, [*keys, "_chunk"]).withColumn(
        name, F.col("_runs") + F.col("_first") + F.col("_n")
    )
    if start:
        out = out.withColumn(start, F.coalesce("_s", "_own", "_from"))
    return out.drop("_chunk", "_back", "_inner", "_n", "_s", "_first", "_own", "_runs", "_from")


def above_low(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], size: int = 2048
) -> DataFrame:
    """Each running sum's height above its lowest point so far, that point at most 0.

    A sum clipped at zero on every step, in closed form. A chunk folds to its total and its lowest
    running sum, which is all later chunks need of it.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(size)))
    local = local.withColumns({f"_c_{n}": F.sum(v).over(upto) for n, v in values.items()})
    local = local.withColumns({f"_m_{n}": F.min(f"_c_{n}").over(upto) for n in values})
    folds = [
        part
        for n, v in values.items()
        for part in (F.sum(v).alias(f"_t_{n}"), F.min(f"_c_{n}").alias(f"_l_{n}"))
    ]
    chunks = local.groupBy(*keys, "_chunk").agg(*folds)
    chunks = chunks.withColumns(
        {f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)) for n in values}
    )
    chunks = chunks.select(
        *keys, "_chunk",
        *[f"_o_{n}" for n in values],
        *[F.min(F.col(f"_o_{n}") + F.col(f"_l_{n}")).over(earlier).alias(f"_b_{n}") for n in values],
    )
    out = local.join(chunks, [*keys, "_chunk"])
    heights = {
        n: F.col(f"_o_{n}") + F.col(f"_c_{n}")
        - F.least(F.lit(0.0), F.col(f"_b_{n}"), F.col(f"_o_{n}") + F.col(f"_m_{n}"))
        for n in values
    }
    return out.select(*df.columns, *[h.alias(n) for n, h in heights.items()])


def _bucket(cuts: Column, value: Column, width: int) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``, by binary search."""
    steps, jump = [], 1
    while jump < width:
        jump *= 2
    while jump >= 1:
        steps.append(F.lit(jump))
        jump //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, jump: F.when(
            (at + jump <= F.size(cuts)) & (F.get(cuts, at + jump - 1) < value), at + jump
        ).otherwise(at),
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    count: str | None = None, splits: int = 64,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one row per key with one column each.

    Equal values are counted first (a partial aggregate), a content-hashed sample of at most
    ``splits`` values per key cuts each key into buckets, bucket totals locate the wanted ranks, and
    only the buckets that hold one are sorted. No task ever holds a key's values.
    """
    whole = not keys
    if whole:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    mark = F.xxhash64("_v")
    cuts = (
        counts.groupBy(*keys, F.pmod(mark, F.lit(splits)).alias("_s"))
        .agg(F.min_by(F.struct("_v", "_n"), mark).alias("_pick"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_pick._v")).alias("_cuts"))
    )  # taking _v with _n keeps this branch's columns, so the counting shuffle is reused
    placed = counts.join(cuts, list(keys)).select(
        *keys, "_v", "_n", _bucket(F.col("_cuts"), F.col("_v"), splits).alias("_b")
    )
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_held"))
        .withColumn("_start", F.coalesce(F.sum("_held").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_held").over(per_key))
    )

    def rank(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    def holds(position: Column, start: Column, held: Column) -> Column:
        return (start <= position) & (position < start + held)

    wanted = F.lit(False)
    for p in probs.values():
        for edge in (F.floor(rank(p)), F.ceil(rank(p))):
            wanted = wanted | holds(edge, F.col("_start"), F.col("_held"))
    inside = (
        Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = placed.join(
        totals.where(wanted).select(*keys, "_b", "_start", "_total"), [*keys, "_b"]
    ).withColumn("_at", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    parts = []
    for i, p in enumerate(probs.values()):
        for side, edge in (("lo", F.floor(rank(p))), ("hi", F.ceil(rank(p)))):
            hit = holds(edge, F.col("_at"), F.col("_n"))
            parts.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *parts)
    out = found.select(
        *keys,
        *[
            (
                F.col(f"_lo{i}")
                + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (rank(p) - F.floor(rank(p)))
            ).alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
        *([F.col("_total").alias(count)] if count else []),
    )
    return out.drop("_all") if whole else out


def period_join(
    facts: DataFrame, periods: DataFrame, keys: Sequence[str], at: str,
    start: str, end: str, bucket: int, closed_end: bool = True, how: str = "inner",
) -> DataFrame:
    """Join facts to the periods holding their ``at`` (BIGINT), as an equi join on time buckets.

    Periods are repeated once per bucket they touch, so neither side is broadcast by force and a hot
    key spreads over its buckets. ``end`` must not be NULL: clamp open periods to the data first.
    """
    spread = periods.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))),
    )
    inside = F.col(at) <= F.col(end) if closed_end else F.col(at) < F.col(end)
    left = facts.withColumn("_bucket", F.floor(F.col(at) / bucket)).alias("f")
    right = spread.alias("p")
    match = F.col("f._bucket") == F.col("p._bucket")
    for key in keys:
        match = match & (F.col(f"f.{key}") == F.col(f"p.{key}"))
    match = match & (F.col(at) >= F.col(start)) & inside
    joined = left.join(right, match, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    extra = [c for c in periods.columns if c not in keys]
    return joined.select(
        *[F.col(f"f.{c}") for c in facts.columns], *[F.col(f"p.{c}") for c in extra]
    )
