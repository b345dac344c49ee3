"""Control charts on standardised residuals: CUSUM and EWMA with gap resets, and their pieces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.stats import MAD_SCALE
from sensorloom.operators.scale import above_low, framed, numbered, quantiles, runs
from sensorloom.session import checkpoint


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: the median and the scaled median absolute deviation."""
    middle = checkpoint(quantiles(df, keys, value, {"median": 0.5}))  # one row per key, read twice
    apart = df.join(middle, list(keys)).withColumn(
        "_apart", F.abs(F.col(value) - F.col("median"))
    )
    spread = quantiles(apart, keys, "_apart", {"_mad": 0.5})
    return middle.join(spread, list(keys)).select(
        *keys, "median", (F.col("_mad") * MAD_SCALE).alias("sigma")
    )


def segments(df: DataFrame, keys: Sequence[str], value: str, reset: int) -> DataFrame:
    """Real steps only, with the first step of their stretch since a gap of over ``reset`` steps."""
    real = df.where(F.col(value).isNotNull())
    return runs(
        real, keys, "step", lambda was, now: now - was > reset + 1, "_run", start="segment"
    ).drop("_run")


def cusum(df: DataFrame, keys: Sequence[str], z: str = "z", allowance: float = 0.5,
          reset: int | None = 8, stretches: DataFrame | None = None) -> DataFrame:
    """Two-sided CUSUM in closed form: a running sum less its lowest point so far in the segment.

    With ``reset`` None the series is one segment and missing steps are simply absent. ``stretches`` takes the
    place of ``df`` where its segments are known already.
    """
    if stretches is not None:
        pass
    elif reset is None:
        stretches = df.where(F.col(z).isNotNull()).withColumn("segment", F.lit(0).cast("bigint"))
    else:
        stretches = segments(df, keys, z, reset)
    out = above_low(
        stretches, [*keys, "segment"], "step",
        {"high": F.col(z) - allowance, "low": -F.col(z) - allowance},
    )
    return out.withColumn("cusum", F.greatest("high", "low"))


def ewma(df: DataFrame, keys: Sequence[str], z: str = "z", lam: float = 0.2, reset: int | None = 8,
         reach: int = 256, block: int = 1024, exact_variance: bool = False,
         stretches: DataFrame | None = None) -> DataFrame:
    """EWMA in standard deviations of itself.

    The average is a geometrically weighted running sum. Real steps are numbered inside their
    segment and cut into blocks with a halo of ``reach`` steps, beyond which a weight is under
    0.8 ** 256, so the blocks are exact to rounding and the weights stay in range. ``stretches`` is as for
    :func:`cusum`.
    """
    if stretches is not None:
        pass
    elif reset is None:
        stretches = df.where(F.col(z).isNotNull()).withColumn("segment", F.lit(0).cast("bigint"))
    else:
        stretches = segments(df, keys, z, reset)
    inside = [*keys, "segment"]
    placed = numbered(stretches, inside, "step", "_at")
    keep = 1.0 - lam
    place = F.col("_at") - F.col("_block") * block
    weighted = F.col(z) * F.pow(F.lit(keep), -place.cast("double"))
    out = framed(
        placed, inside, "_at",
        {
            "average": lambda w: F.lit(lam)
            * F.pow(F.lit(keep), place.cast("double"))
            * F.sum(weighted).over(w.rowsBetween(Window.unboundedPreceding, 0))
        },
        before=reach, block=block,
    )
    if exact_variance:
        seen = F.col("_at") + 1
        spread = F.sqrt(lam / (2.0 - lam) * (1.0 - F.pow(F.lit(keep), 2.0 * seen)))
    else:
        spread = F.lit(math.sqrt(lam / (2.0 - lam)))
    return out.withColumn("ewma", F.abs("average") / spread).drop("_at")


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lag-one autocorrelation over the steps whose predecessor is real too; 0 with under 3 values."""
    lagged = framed(df, keys, "step", {"_back": lambda w: F.lag(value).over(w)}, before=1)
    both = F.col(value).isNotNull() & F.col("_back").isNotNull()
    return lagged.groupBy(*keys).agg(
        F.when(
            F.count(value) > 2,
            F.corr(F.when(both, F.col(value)), F.when(both, F.col("_back"))),
        ).otherwise(0.0).alias("rho")
    )


def siblings(df: DataFrame, group: Sequence[str], member: str, value: str, name: str = "siblings") -> DataFrame:
    """The largest value among the other members of the group: the group's top two, no self join.

    A group is one site at one step, so its members are the site's few sensors.
    """
    ranked = df.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.max_by(member, F.struct(value, member)).alias("_who"),
        F.max(value).alias("_top"),
        F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 2).alias("_two"),
    )
    return (
        df.join(ranked, list(group), "left")
        .withColumn(
            name,
            F.when(F.col(member) == F.col("_who"), F.get("_two", F.lit(1))).otherwise(F.col("_top")),
        )
        .drop("_who", "_top", "_two")
    )


def corroborated(df: DataFrame, keys: Sequence[str], ratio: str, others: str, name: str) -> DataFrame:
    """A spike counts only as far as the step before or another sensor agrees."""
    out = framed(df, keys, "step", {"_back": lambda w: F.lag(ratio).over(w)}, before=1)
    agree = F.greatest("_back", F.col(others))
    return out.withColumn(name, F.least(F.col(ratio), agree)).drop("_back")
