"""Exploration: fixed-width histograms and contiguous stretches of stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.scale import prefix, quantiles, runs


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Counts per bin with edges at multiples of ``width``; the last bin is closed on the right."""
    ends = df.groupBy(*keys).agg(
        F.floor(F.min(value) / width).alias("_lo"), F.ceil(F.max(value) / width).alias("_hi")
    ).withColumn("_hi", F.greatest("_hi", F.col("_lo") + 1))
    spine = ends.select(*keys, F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_bin"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).alias("_raw")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    folded = counts.join(ends, list(keys)).groupBy(*keys, F.least("_raw", F.col("_hi") - 1).alias("_bin")).agg(
        F.sum("_n").alias("_n")
    )
    return spine.join(folded, [*keys, "_bin"], "left").select(
        *keys, (F.col("_bin") * width).alias("edge"), F.coalesce("_n", F.lit(0)).alias("n")
    )


def contiguous_ranges(df: DataFrame, keys: Sequence[str], at: str, tolerance: int = 3, size: int = 2048) -> DataFrame:
    """(keys, first, last) of the stretches whose gaps stay within a multiple of the median gap."""
    gaps = prefix(df, keys, at, {"_p": ("prev", F.col(at))}, size).select(*keys, (F.col(at) - F.col("_p")).alias("_gap"))
    usual = quantiles(gaps, keys, "_gap", {"_mid": 0.5})
    placed = df.join(usual, list(keys), "left").withColumn(
        "_at", F.struct(F.col(at).alias("t"), (F.col("_mid") * tolerance).alias("most"))
    )
    marked = runs(placed, keys, at, lambda was, now: now["t"] - was["t"] > now["most"], "_run", size, also="_at")
    return marked.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_run")
