"""Sensor health: failed readings, silent and muted sensors, level shifts, drift, table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.operators.scale import prefix, quantiles

MICROS = 1_000_000
DAY_US = 86_400 * MICROS


def table_check(readings: DataFrame, keys: Sequence[str], span: tuple[float, float], now_us: int,
                step_seconds: int, slack_seconds: int, chunk_us: int) -> DataFrame:
    """(keys, problem, readings) for each broken constraint: span, repeats, order, future, cadence."""
    led = prefix(readings, keys, "seq", {"_p": ("prev", F.col("us"))}, 1 << 16)
    led = led.withColumn("gap", F.col("us") - F.col("_p"))
    distinct = readings.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("_c"))
    repeats = distinct.groupBy(*keys).agg(F.sum(F.col("_c") - 1).alias("repeated times"))
    counts = led.groupBy(*keys).agg(
        F.count_if((F.col("value") < span[0]) | (F.col("value") > span[1])).alias("outside span"),
        F.count_if(F.col("gap") < 0).alias("times out of order"),
        F.count_if(F.col("us") > now_us).alias("times in the future"),
    )
    pace = quantiles(led, keys, "gap", {"_mid": 0.5}).select(
        *keys,
        F.when(F.abs(F.col("_mid") - step_seconds * MICROS) > slack_seconds * MICROS, 1)
        .otherwise(0).cast("bigint").alias("not on cadence"),
    )
    wide = counts.join(repeats, list(keys)).join(pace, list(keys), "left")
    names = ["outside span", "repeated times", "times out of order", "times in the future", "not on cadence"]
    return wide.unpivot(list(keys), names, "problem", "readings").where("readings > 0")


def reading_problems(screened: DataFrame, keys: Sequence[str], fail: int = 4) -> DataFrame:
    """Sensors with failed readings: the last failed value and how many."""
    bad = F.when((F.col("flag") == fail) & F.col("value").isNotNull(), F.col("us"))
    out = screened.groupBy(*keys).agg(F.max_by("value", bad).alias("value"), F.count(bad).alias("readings"))
    return out.where("readings > 0")


def dead_feeds(sensors: DataFrame, readings: DataFrame, keys: Sequence[str], now_us: int, hours: float) -> DataFrame:
    """Sensors silent for over ``hours``, or with no reading at all."""
    newest = readings.where("value IS NOT NULL").groupBy(*keys).agg(F.max("us").alias("newest"))
    out = sensors.select(*keys).join(newest, list(keys), "left")
    return out.where(F.col("newest").isNull() | (now_us - F.col("newest") > hours * 3600 * MICROS))


def level_shifts(readings: DataFrame, keys: Sequence[str], cut_us: int, history_us: int, need: int,
                 factor: float) -> DataFrame:
    """Current against historic median, where both have enough readings and moved by the factor."""
    recent = (F.col("us") >= cut_us).alias("_now")
    rows = readings.where((F.col("us") >= cut_us - history_us) & F.col("value").isNotNull()).select(*keys, "value", recent)
    q = quantiles(rows, [*keys, "_now"], "value", {"m": 0.5}, count="n").groupBy(*keys).agg(
        F.max(F.when(F.col("_now"), F.struct("m", "n"))).alias("c"), F.max(F.when(~F.col("_now"), F.struct("m", "n"))).alias("h")
    )
    now, usual = F.col("c.m"), F.col("h.m")
    ratio = F.greatest(now / usual, usual / now)
    return q.where(
        (F.col("c.n") >= need) & (F.col("h.n") >= need) & (now > 0) & (usual > 0) & (ratio >= factor)
    ).select(*keys, now.alias("current"), usual.alias("usual"), ratio.alias("factor"))


def daily_ranges(readings: DataFrame, keys: Sequence[str], full: int) -> DataFrame:
    """Range of readings per full UTC day."""
    day = F.floor(F.col("us") / DAY_US).alias("day")
    out = readings.where("value IS NOT NULL").groupBy(*keys, day).agg(
        (F.max("value") - F.min("value")).alias("range"), F.count("value").alias("n")
    )
    return out.where(F.col("n") >= full)


def muted(ranges: DataFrame, keys: Sequence[str], cut_day: Column, need: int, days: int = 2,
          low: float = 0.05, share: float = 0.25) -> DataFrame:
    """Sensors whose last days all stay far under their usual daily range. One row per sensor and day in."""
    split = ranges.join(cut_day, list(keys)) if isinstance(cut_day, DataFrame) else ranges.withColumn("_cut", cut_day)
    usual = quantiles(split.where("day < _cut"), keys, "range", {"_q": low, "usual": 0.5}, count="_n")
    w = Window.partitionBy(*keys).orderBy(F.desc("day"))
    last = split.where("day >= _cut").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= days)
    floor = F.least(F.col("_q"), F.col("usual") * share)
    out = last.join(usual, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_seen"), F.bool_and(F.col("range") < floor).alias("_calm"),
        F.max_by("range", "day").alias("range"), F.first("usual").alias("usual"), F.first("_n").alias("_n"),
        F.first(floor).alias("_floor"),
    )
    return out.where((F.col("_seen") >= days) & F.col("_calm") & (F.col("_n") >= need) & (F.col("_floor") > 0)).select(
        *keys, "range", "usual"
    )


def wasserstein(current: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, width: float, need: int = 1) -> DataFrame:
    """1-D Wasserstein distance per key over the reference's deviation, exact.

    No ratio with under ``need`` readings on either side, nor where the reference does not vary.

    The integral of the gap between the two empirical distributions: equal values are counted, running
    counts come from chunks of the value axis, and each gap is weighed by the step to the next value.
    """
    a = current.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_a"), F.lit(0).cast("bigint").alias("_b"))
    b = reference.groupBy(*keys, value).agg(F.lit(0).cast("bigint").alias("_a"), F.count(F.lit(1)).alias("_b"))
    merged = a.unionByName(b).groupBy(*keys, value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    ran = prefix(merged, keys, value, {"_ca": ("sum", F.col("_a")), "_cb": ("sum", F.col("_b"))}, width)
    ran = prefix(ran, keys, value, {"_next": ("prev", F.col(value))}, width, reverse=True, source=merged)
    sizes = merged.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    spread = reference.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    gap = F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb")) * (F.col("_next") - F.col(value))
    out = ran.join(sizes, list(keys)).groupBy(*keys).agg(
        F.sum(gap).alias("distance"), F.first("_na").alias("n_current"), F.first("_nb").alias("n_reference")
    )
    judged = (F.least("n_current", "n_reference") >= need) & (F.col("_sd") > 0)
    return out.join(spread, list(keys)).withColumn("ratio", F.when(judged, F.col("distance") / F.col("_sd"))).drop("_sd")


def reference_sample(readings: DataFrame, keys: Sequence[str], size: int, splits: int = 64) -> DataFrame:
    """The same ``size`` readings every time, in any engine: those with the smallest MD5 of their number per key.

    Ranks are first cut per hash slice, so no key is ever sorted whole.
    """
    mark = F.md5(F.col("seq").cast("string").cast("binary"))
    local = Window.partitionBy(*keys, "_slice").orderBy("_mark")
    whole = Window.partitionBy(*keys).orderBy("_mark")
    out = readings.withColumn("_mark", mark).withColumn("_slice", F.pmod(F.xxhash64("_mark"), F.lit(splits)))
    out = out.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= size)
    return out.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= size).drop("_mark", "_slice", "_r")


def site_status(sensors: DataFrame, newest: DataFrame, flagged: DataFrame, muted_sites: DataFrame, paused: DataFrame,
                now_us: int, late_hours: float) -> DataFrame:
    """flagged > no data > late > paused > muted > normal, per site."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("site").distinct().withColumn(name, F.lit(True))

    out = sensors.select("site").distinct().join(newest, "site", "left")
    for df, name in ((flagged, "_f"), (muted_sites, "_m"), (paused, "_p")):
        out = out.join(mark(df, name), "site", "left")
    late = now_us - F.col("newest") > late_hours * 3600 * MICROS
    status = (
        F.when(F.col("_f").isNotNull(), "flagged").when(F.col("newest").isNull(), "no data").when(late, "late")
        .when(F.col("_p").isNotNull(), "paused").when(F.col("_m").isNotNull(), "muted").otherwise("normal")
    )
    return out.select("site", status.alias("status"))
