"""Rain totals, dryness, and the multiplier that raises an alert line in the wet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.scale import framed, prefix

# The gate's defaults.
MULTIPLIER = 2.0
DECAY_HOURS = 36.0
WET_MM = 0.1
LOOKBACK_HOURS = 12.0


def wetness(rain: DataFrame, seconds: int, lookback_hours: float = LOOKBACK_HOURS,
            wet_mm: float = WET_MM, fill: bool = True) -> DataFrame:
    """Per step: the trailing total (this step included) and the hours since the last wet step.

    ``fill`` reads a missing amount as dry, the scoring path's choice. Hours are NULL before any rain.
    """
    amount = F.coalesce("rain", F.lit(0.0)) if fill else F.col("rain")
    back = int(lookback_hours * 3600 // seconds)
    out = rain.withColumn("rain", amount)
    out = framed(
        out, [], "step", {"total": lambda w: F.sum("rain").over(w.rangeBetween(-back, 0))}, before=back
    )
    wet_step = F.when(F.col("rain") > wet_mm, F.col("step"))
    out = prefix(out, [], "step", {"_wet": ("max", wet_step)})
    return out.withColumn("dry_hours", (F.col("step") - F.col("_wet")) * (seconds / 3600.0)).drop("_wet")


def multiplier(mode: str, total: Column, dry_hours: Column, m: float = MULTIPLIER,
               wet_mm: float = WET_MM, lookback_hours: float = LOOKBACK_HOURS,
               decay_hours: float = DECAY_HOURS) -> Column:
    """How far the line is raised, from 1 to ``m``."""
    def held(hours: Column) -> Column:
        return F.least(F.greatest(hours / decay_hours, F.lit(0.0)), F.lit(1.0))

    if mode == "off":
        return F.lit(1.0)
    if mode == "step":
        return F.when(total > wet_mm, m).otherwise(1.0)
    if mode == "decay":
        return F.when(dry_hours.isNull(), 1.0).otherwise(1.0 + (m - 1.0) * (1.0 - held(dry_hours)))
    if mode == "deployed":
        taper = 1.0 + (m - 1.0) * (1.0 - held(dry_hours - lookback_hours))
        return F.when(total > wet_mm, m).when(dry_hours.isNull(), 1.0).otherwise(taper)
    raise ValueError(f"unknown rain mode {mode!r}")


def node_multiplier(shared: Column, own: Column, m: float = MULTIPLIER) -> Column:
    """A node's own multiplier rescales only the raised part."""
    return 1.0 + (own - 1.0) * ((shared - 1.0) / (m - 1.0) if m > 1.0 else F.lit(0.0))


def fired(score: Column, line: Column) -> Column:
    """Over the line; a score that could not be computed never fires."""
    clean = F.when(~F.isnan(score), score)
    return F.coalesce(clean > line, F.lit(False))
