"""Every runnable query, gathered from the family modules."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.operators import charts as control, frames, grid, rules
from sensorloom.operators.scale import quantiles
from sensorloom.plans import registry
from sensorloom.session import checkpoint
from sensorloom.sources import tables

FAMILIES = ("grids", "charts", "quality", "tails", "flow", "linear", "grading", "health", "feeds", "lifecycle")

for _family in FAMILIES:
    importlib.import_module(f"sensorloom.plans.{_family}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts from raw readings: grid, level, spread, control charts, lines per test, noticed groups.

    Per site on a six-hour grid, so that it also judges the smallest tables.
    """
    keys = ["site"]
    series = checkpoint(grid.on_grid(tables.readings(spark, folder), keys, 6 * 3600))
    leveled = checkpoint(
        frames.level(series, keys, 8).withColumn("resid", F.col("value") - F.col("level"))
    )
    spread = control.median_and_mad(leveled, keys, "resid").select("site", F.greatest("sigma", F.lit(1.0)).alias("floor"))
    z = checkpoint(leveled.join(spread, "site").withColumn("z", F.col("resid") / F.col("floor")))
    at = ["site", "step"]
    scored = (
        frames.hampel(z, keys, F.col("floor"), value="resid").select(*at, "hampel")
        .join(control.cusum(z, keys).select(*at, "cusum"), at, "left")
        .join(control.ewma(z, keys).select(*at, "ewma"), at, "left")
        .unpivot(at, ["hampel", "cusum", "ewma"], "rule", "score").where("score IS NOT NULL")
    )
    scored = checkpoint(scored)
    lines = quantiles(scored, ["rule"], "score", {"base": 0.95})
    return rules.notice(scored.join(lines, "rule").withColumn("threshold", F.col("base")), ["site", "rule"])
