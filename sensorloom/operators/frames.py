"""Rolling statistics over bounded frames, each named for the frame it reads."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.stats import MAD_SCALE, median_of
from sensorloom.operators import sliding
from sensorloom.operators.scale import framed, prefix

WIDE = 32  # from this width on a rank index is cheaper than sorting each window; both give the same medians


def trailing_median(df: DataFrame, keys: Sequence[str], rows: int, value: str = "value",
                    name: str = "median") -> DataFrame:
    """Median of the last ``rows`` values, this one included, over fewer at the start."""
    if rows >= WIDE:
        def work(values, present):
            middle, seen = sliding.RankIndex(values, present).medians(*sliding.window(len(values), 1 - rows, 0))
            return [(middle, seen > 0)]

        return sliding.per_block(df, keys, "step", value, f"{name} double", work, rows, 0)
    return framed(
        df, keys, "step",
        {name: lambda w: median_of(F.collect_list(value).over(w.rowsBetween(1 - rows, 0)))},
        before=rows,
    )


def level(df: DataFrame, keys: Sequence[str], width: int, min_real: float = 0.75,
          value: str = "value", name: str = "level") -> DataFrame:
    """Median of the previous ``width`` steps, this one left out, where enough of them are real.

    A series no longer than the window has no level at all.
    """
    need = -int(-min_real * width // 1)
    if width >= WIDE:
        def work(values, present):
            middle, seen = sliding.RankIndex(values, present).medians(*sliding.window(len(values), -width, -1))
            low, high = sliding.window(len(values), -width, width)
            return [(middle, (high - low > width) & (seen >= max(need, 1)))]

        return sliding.per_block(df, keys, "step", value, f"{name} double", work, width, width)
    out = framed(
        df, keys, "step",
        {
            "_seen": lambda w: F.collect_list(value).over(w.rowsBetween(-width, -1)),
            # over ``width`` rows around any row exactly when the series is longer than that
            "_steps": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-width, width)),
        },
        before=width, after=width,
    )
    return out.withColumn(
        name, F.when((F.col("_steps") > width) & (F.size("_seen") >= need), median_of(F.col("_seen")))
    ).drop("_seen", "_steps")


def _spread_frame(df: DataFrame, keys: Sequence[str], width: int, value: str) -> DataFrame:
    """Trailing window's values, median and raw MAD. Needs the whole series as long as the window."""
    out = framed(
        df, keys, "step",
        {
            "_seen": lambda w: F.collect_list(value).over(w.rowsBetween(1 - width, 0)),
            "_steps": lambda w: F.count(F.lit(1)).over(w.rowsBetween(1 - width, width - 1)),
        },
        before=width, after=width,
    )
    out = out.withColumn("_median", median_of(F.col("_seen")))
    apart = F.transform("_seen", lambda x: F.abs(x - F.col("_median")))
    return out.withColumn("_mad", median_of(apart))


def hampel(df: DataFrame, keys: Sequence[str], floor: Column, width: int = 13,
           min_real: float = 0.75, value: str = "value", name: str = "hampel") -> DataFrame:
    """Distance from the trailing median in scaled MADs, where enough of the window is real."""
    need = -int(-min_real * width // 1)
    out = _spread_frame(df, keys, width, value)
    judged = (
        (F.col("_steps") >= width) & F.col(value).isNotNull() & (F.size("_seen") >= need)
    )
    ratio = F.abs(F.col(value) - F.col("_median")) / F.greatest(F.col("_mad") * MAD_SCALE, floor)
    return out.withColumn(name, F.when(judged, ratio)).drop("_seen", "_steps", "_median", "_mad")


def x84(df: DataFrame, keys: Sequence[str], k: float = 5.2, width: int = 13,
        value: str = "value", name: str = "x84") -> DataFrame:
    """The naive comparison test: raw MADs, no guard on how much of the window is real."""
    out = _spread_frame(df, keys, width, value)
    judged = (F.col("_steps") >= width) & F.col(value).isNotNull()
    ratio = F.abs(F.col(value) - F.col("_median")) / F.greatest(F.col("_mad"), F.lit(1e-9)) / k
    return out.withColumn(name, F.when(judged, ratio)).drop("_seen", "_steps", "_median", "_mad")


def centred_outlier(df: DataFrame, keys: Sequence[str], order: str, k: float, width: int = 96,
                    value: str = "value") -> DataFrame:
    """Hampel outliers in centred windows, each deviation from its own point's median."""
    first, last = -(width // 2), width - width // 2 - 1

    def work(values, present):
        near = sliding.window(len(values), first, last)
        middle, seen = sliding.RankIndex(values, present).medians(*near)
        judged = present & (seen > 0)
        apart = np.where(judged, np.abs(values - middle), 0.0)
        scale, _ = sliding.RankIndex(apart, judged).medians(*near)
        # NaN is above all numbers and equal to itself, as in Spark
        line = scale * (k * MAD_SCALE)
        return [((apart > line) | (np.isnan(apart) & ~np.isnan(line)), judged)]

    return sliding.per_block(df, keys, order, value, "outlier boolean", work, width, width)


def daily_profile(df: DataFrame, site_keys: Sequence[str], value: str, day: str, slot: str,
                  days: int = 14, need: int = 3) -> tuple[DataFrame, DataFrame]:
    """(profile in force per day and slot, latest profile per slot) over the previous ``days`` days.

    A table cell holds one sensor's readings in one slot of one local day, so its median is small
    work; the rolling median over days then runs per (sensor, slot).
    """
    cells = df.groupBy(*site_keys, slot, day).agg(F.percentile(value, 0.5).alias("_cell"))
    ends = cells.groupBy(*site_keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    slots = cells.select(*site_keys, slot).distinct()
    calendar = slots.join(ends, list(site_keys)).select(
        *site_keys, slot, "_last", F.explode(F.sequence("_first", "_last")).alias(day)
    )
    table = calendar.join(cells, [*site_keys, slot, day], "left")
    w = Window.partitionBy(*site_keys, slot).orderBy(day)
    before, upto = w.rowsBetween(-days, -1), w.rowsBetween(1 - days, 0)

    def middle(frame) -> Column:
        seen = F.count("_cell").over(frame)
        return F.when(seen >= need, F.percentile("_cell", 0.5).over(frame)).otherwise(0.0)

    both = table.withColumns({"profile": middle(before), "_latest": middle(upto)})
    latest = both.where(F.col(day) == F.col("_last")).select(
        *site_keys, slot, F.col("_latest").alias("profile")
    )
    return both.select(*site_keys, slot, day, "profile"), latest


def evenly_spread(df: DataFrame, keys: Sequence[str], order: str, count: int, size: int = 2048) -> DataFrame:
    """``count`` rows per key at evenly spread positions (rounded half to even), all if fewer."""
    from sensorloom.operators.scale import numbered

    placed = numbered(df, keys, order, "_at", size)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_of"))
    picks = sizes.select(
        *keys,
        F.explode(
            F.when(
                F.col("_of") > count,
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(count - 1)),
                        lambda i: F.bround(i * (F.col("_of") - 1) / F.lit(count - 1)).cast("bigint"),
                    )
                ),
            ).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - 1))
        ).alias("_at"),
    )
    return placed.join(picks, [*keys, "_at"]).drop("_at")


def carried_then_backfilled(df: DataFrame, keys: Sequence[str], value: str, size: int = 2048) -> DataFrame:
    """Forward fill, then backward fill what the start left empty."""
    out = prefix(df, keys, "step", {"_f": ("last", F.col(value))}, size)
    out = prefix(out, keys, "step", {"_b": ("last", F.col(value))}, size, reverse=True, source=df)
    return out.withColumn("filled", F.coalesce("_f", "_b")).drop("_f", "_b")
