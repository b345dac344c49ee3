"""The reviewed level: screened readings less the field log's periods, and what removed each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.scale import period_join

SCREENED = -1


def keep(screened: DataFrame, excluded: Sequence[int]) -> DataFrame:
    """The value a model may read: blank where its flag is one the model excludes."""
    return screened.withColumn("kept", F.when(~F.col("flag").isin(*excluded), F.col("value")))


def excluded_by(readings: DataFrame, log: DataFrame, keys: Sequence[str], bucket_us: int) -> DataFrame:
    """Adds the first log line whose period holds the reading, 0 where none does.

    Open periods end with the data. Matches are found on time buckets and folded to one line per
    reading before they meet the readings again.
    """
    newest = readings.agg(F.max("us").alias("_newest"))
    periods = log.crossJoin(newest).select(
        *keys, "line", F.col("a").alias("_start"), F.coalesce("b", "_newest").alias("_end")
    ).where("_end >= _start")
    lines = (
        period_join(readings.select(*keys, "us").distinct(), periods, keys, "us", "_start", "_end", bucket_us)
        .groupBy(*keys, "us")
        .agg(F.min("line").alias("line"))
    )
    out = readings.join(lines, [*keys, "us"], "left")
    return out.withColumn("line", F.coalesce("line", F.lit(0)))


def review(screened: DataFrame, log: DataFrame, keys: Sequence[str], bucket_us: int,
           excluded: Sequence[int] = (4, 9)) -> DataFrame:
    """Readings only, with removed_by: 0 kept, -1 screened, otherwise the log line."""
    present = excluded_by(screened.where("value IS NOT NULL"), log, keys, bucket_us)
    cause = (
        F.when(F.col("line") > 0, F.col("line"))
        .when(F.col("flag").isin(*excluded), SCREENED)
        .otherwise(0)
    )
    out = present.withColumn("removed_by", cause)
    return out.withColumn("value", F.when(F.col("removed_by") == 0, F.col("value"))).drop("line")


def in_force(rows: DataFrame, versions: DataFrame, at: str, applied: str, bucket: int) -> DataFrame:
    """Adds the version applied last at each row's moment, the first version before any was."""
    from pyspark.sql import Window

    w = Window.orderBy(applied)  # one row per applied setting
    ends = rows.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    spans = versions.select(
        "*", F.lead(applied).over(w).alias("_next"), F.row_number().over(w).alias("_r")
    ).crossJoin(ends)
    start = F.when(F.col("_r") == 1, F.least("_lo", F.col(applied))).otherwise(F.col(applied))
    spans = spans.select(
        *[c for c in versions.columns if c != applied], start.alias("_from"),
        F.coalesce("_next", F.greatest(F.col("_hi"), F.col(applied)) + 1).alias("_until"),
    )
    return period_join(rows, spans, [], at, "_from", "_until", bucket, closed_end=False).drop("_from", "_until")
