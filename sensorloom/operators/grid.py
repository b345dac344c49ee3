"""Regular grids: resampling, complete spines, as-of and nearest alignment, gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.operators.scale import framed, prefix

MICROS = 1_000_000


def step_of(us: Column | str, seconds: int) -> Column:
    """The grid step (counted from the epoch) a moment falls in, floored."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(seconds * MICROS))


def resample(
    df: DataFrame, keys: Sequence[str], seconds: int, measures: Mapping[str, Column]
) -> DataFrame:
    """One row per key and step. Use ``avg`` for instantaneous and ``sum`` for accumulated measures."""
    return (
        df.withColumn("step", step_of("us", seconds))
        .groupBy(*keys, "step")
        .agg(*[m.alias(n) for n, m in measures.items()])
    )


def spine(df: DataFrame, keys: Sequence[str], chunk: int = 4096) -> DataFrame:
    """Every step from each key's first to its last, made in two explodes so a long key spreads."""
    ends = df.groupBy(*keys).agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    starts = ends.withColumn(
        "_from", F.explode(F.sequence("_lo", "_hi", F.lit(chunk).cast("bigint")))
    )
    return starts.select(
        *keys,
        F.explode(
            F.sequence("_from", F.least(F.col("_from") + chunk - 1, F.col("_hi")))
        ).alias("step"),
    )


def complete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A gridded frame with NULL rows for the steps nothing fell in."""
    return spine(df, keys).join(df, [*keys, "step"], "left")


def on_grid(readings: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Mean reading per step on a complete grid per key."""
    return complete(resample(readings, keys, seconds, {"value": F.avg("value")}), keys)


def shared_extent(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The latest first and the latest last reading over all keys."""
    per = df.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    return per.agg(F.max("_first").alias("start"), F.max("_last").alias("end"))


def asof_backward(
    grid: DataFrame, observations: DataFrame, keys: Sequence[str], seconds: int, chunk_steps: int = 2048
) -> DataFrame:
    """The last observation at or before each grid step, and its age in steps.

    Steps before the first observation take the mean of the carried values and a staleness of the
    whole grid's length. Grid and observations are merged into one sorted series.
    """
    marks = observations.where("value IS NOT NULL").select(
        *keys, "us", F.lit(0).alias("_kind"), F.struct("us", "value").alias("_seen")
    )
    ticks = grid.select(
        *keys,
        (F.col("step") * (seconds * MICROS)).alias("us"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("struct<us:bigint,value:double>").alias("_seen"),
    )
    carried = (
        prefix(
            marks.unionByName(ticks), keys, "us", {"_held": ("last", F.col("_seen"))},
            chunk_steps * seconds * MICROS, tie=("_kind",),
        )
        .where("_kind = 1")
        .select(
            *keys,
            F.floor(F.col("us") / (seconds * MICROS)).alias("step"),
            F.col("_held.value").alias("_value"),
            ((F.col("us") - F.col("_held.us")) / float(seconds * MICROS)).alias("_age"),
        )
    )
    sizes = carried.groupBy(*keys).agg(
        F.avg("_value").alias("_mean"), F.count(F.lit(1)).alias("_steps")
    )
    return carried.join(sizes, list(keys)).select(
        *keys,
        "step",
        F.coalesce("_value", "_mean", F.lit(0.0)).alias("value"),
        F.coalesce("_age", F.col("_steps").cast("double")).alias("staleness"),
    )


def nearest(
    grid: DataFrame, observations: DataFrame, keys: Sequence[str], seconds: int, tolerance: float
) -> DataFrame:
    """The observation nearest each grid step within ``tolerance`` seconds, the earlier on a tie.

    The tolerance is under a step, so an observation can only serve the steps on its two sides: a
    plain equi join and one aggregate, no sorted merge.
    """
    width = seconds * MICROS
    near = (
        observations.where("value IS NOT NULL")
        .withColumn("_low", F.floor(F.col("us") / width))
        .withColumn("step", F.explode(F.array(F.col("_low"), F.col("_low") + 1)))
        .withColumn("_off", F.abs(F.col("us") - F.col("step") * width))
        .where(F.col("_off") <= tolerance * MICROS)
        .groupBy(*keys, "step")
        .agg(F.min_by("value", F.struct("_off", "us")).alias("target"))
    )
    return grid.join(near, [*keys, "step"], "left").withColumn(
        "has_target", F.col("target").isNotNull()
    )


def fill_short_gaps(df: DataFrame, keys: Sequence[str], limit: int, chunk: int = 2048) -> DataFrame:
    """Linear interpolation inside gaps, at most ``limit`` rows from each gap's start."""
    known = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
    out = prefix(df, keys, "step", {"_left": ("last", known)}, chunk)
    out = prefix(out, keys, "step", {"_right": ("last", known)}, chunk, reverse=True, source=df)
    share = (F.col("step") - F.col("_left.step")) / (F.col("_right.step") - F.col("_left.step"))
    between = F.col("_left.value") + (F.col("_right.value") - F.col("_left.value")) * share
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(
        (F.col("step") - F.col("_left.step") <= limit) & F.col("_right").isNotNull(), between
    )
    return out.withColumn("filled", filled).drop("_left", "_right")


def cadence(df: DataFrame, keys: Sequence[str], chunk_seconds: int, default: int) -> DataFrame:
    """Median spacing of each series to the whole minute (half to even), in seconds."""
    from sensorloom.operators.scale import quantiles

    gaps = prefix(
        df, keys, "us", {"_prev": ("prev", F.col("us"))}, chunk_seconds * MICROS, tie=("seq",)
    ).select(*keys, (F.col("us") - F.col("_prev")).alias("gap"))
    middle = quantiles(gaps, keys, "gap", {"gap": 0.5}, count="gaps")
    minutes = F.bround(F.col("gap") / (60 * MICROS)).cast("bigint") * 60
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("stamps"))
    return every.join(middle, list(keys), "left").select(
        *keys,
        F.when((F.col("stamps") >= 3) & (minutes > 0), minutes)
        .otherwise(F.lit(default))
        .alias("seconds"),
    )


def missing_steps(readings: DataFrame, grid: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Expected steps no reading fell in."""
    seen = readings.select(*keys, step_of("us", seconds).alias("step"))
    return grid.join(seen, [*keys, "step"], "left_anti")


def break_long_gaps(df: DataFrame, keys: Sequence[str], gap_us: int, chunk_us: int) -> DataFrame:
    """Plot rows: a NULL one microsecond after a reading that a long gap follows."""
    led = prefix(df, keys, "us", {"_next": ("prev", F.col("us"))}, chunk_us, tie=("seq",), reverse=True)
    cuts = led.where(F.col("_next") - F.col("us") > gap_us).select(
        *keys, (F.col("us") + 1).alias("us"), F.lit(None).cast("double").alias("value")
    )
    return led.select(*keys, "us", "value").unionByName(cuts)


def all_usable(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Whether a step and the ``width`` before it are all usable and all there."""
    return framed(
        df,
        keys,
        "step",
        {
            "_bad": lambda w: F.max(F.when(F.col("usable"), 0).otherwise(1)).over(
                w.rowsBetween(-width, 0)
            ),
            "_rows": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-width, 0)),
        },
        before=width,
    ).withColumn("whole", (F.col("_bad") == 0) & (F.col("_rows") == width + 1)).drop("_bad", "_rows")
