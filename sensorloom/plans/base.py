"""Frames and SQL shared by the registered queries.

Most queries run on (site, variable) series put on a two-hour grid, some on hourly site series. The
SQL constants state the same inputs for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.functions import clock
from sensorloom.operators import grid
from sensorloom.session import level as stored
from sensorloom.sources import tables

STEP = 7200
HOUR = 3600
US = 1_000_000
DAY_US = 86_400 * US
KEYS = ("site", "variable")

START_US = 1704067200 * US  # 2024-01-01, where the given events begin

EV = """ev AS (
  SELECT event_type AS site,
         CASE user_id % 3 WHEN 0 THEN 'conductivity' WHEN 1 THEN 'depth' ELSE 'temperature' END AS variable,
         epoch_us(ts) AS us, event_id AS seq, value
  FROM events)"""

FAULTY = (
    EV.replace("ev AS (", "clean_ev AS (")
    + """, ev AS (
  SELECT site, variable, us, seq,
         CASE WHEN seq % 101 = 0 THEN -9999.0 WHEN seq % 53 = 0 THEN -20.0
              WHEN seq % 59 = 0 THEN -40.0
              WHEN seq % 61 = 0 THEN NULL ELSE value END AS value
  FROM clean_ev)"""
)

GRID = (
    EV
    + f""", bins AS (
  SELECT site, variable, us // {STEP * US} AS step, avg(value) AS value FROM ev GROUP BY ALL),
spine AS (
  SELECT site, variable, unnest(range(a, b)) AS step FROM (
    SELECT site, variable, min(step) AS a, max(step) + 1 AS b FROM bins GROUP BY ALL)),
g AS (
  SELECT s.site, s.variable, s.step, b.value FROM spine s LEFT JOIN bins b USING (site, variable, step))"""
)

SITEGRID = (
    EV
    + f""", bins AS (
  SELECT site, us // {HOUR * US} AS step, avg(value) AS value FROM ev GROUP BY ALL),
spine AS (SELECT site, unnest(range(a, b)) AS step FROM (
    SELECT site, min(step) AS a, max(step) + 1 AS b FROM bins GROUP BY ALL)),
g AS (SELECT s.site, s.step, b.value FROM spine s LEFT JOIN bins b USING (site, step))"""
)

RAIN = f"""rainbins AS (
  SELECT us // {STEP * US} AS step, greatest(avg(value) - 100.0, 0.0) / 10.0 AS rain
  FROM ev WHERE site = 'signup' GROUP BY ALL),
rain AS (
  SELECT x.step, r.rain FROM (SELECT unnest(range(min(step), max(step) + 1)) AS step FROM rainbins) x
  LEFT JOIN rainbins r USING (step))"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.readings(spark, sf)


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(site, variable, step, value) on the two-hour grid."""
    return stored(spark, ("series", sf), lambda: grid.on_grid(readings(spark, sf), KEYS, STEP))


def site_series(spark: SparkSession, sf: str) -> DataFrame:
    """(site, step, value) on the hourly grid."""
    return stored(spark, ("sites", sf), lambda: grid.on_grid(readings(spark, sf), ["site"], HOUR))


def rain(spark: SparkSession, sf: str) -> DataFrame:
    """(step, rain): one catchment-wide series on the two-hour grid, NULL where nothing came."""
    mine = readings(spark, sf).where("site = 'signup'")
    binned = grid.resample(mine, [], STEP, {"value": F.avg("value")}).select(
        F.lit("catchment").alias("area"),
        "step",
        (F.greatest(F.col("value") - 100.0, F.lit(0.0)) / 10.0).alias("rain"),
    )
    return stored(spark, ("rain", sf), lambda: grid.complete(binned, ["area"]).drop("area"))




LEVEL_STEPS, HAMPEL_STEPS = 12, 13
RESOLUTION = {"conductivity": 1.0, "depth": 1.0, "temperature": 0.1}


def local_sql(seconds: str) -> str:
    """Seconds of the creek's own clock, daylight saving included, of UTC epoch seconds."""
    return f"epoch(timezone('America/Los_Angeles', to_timestamp({seconds})))::BIGINT"



RESID = (
    GRID
    + f""", lv AS (
  SELECT *, quantile_cont(value, 0.5) OVER p AS mid, count(value) OVER p AS seen,
         count(*) OVER (PARTITION BY site, variable) AS n
  FROM g WINDOW p AS (PARTITION BY site, variable ORDER BY step
                      ROWS BETWEEN {LEVEL_STEPS} PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT site, variable, step, value,
         CASE WHEN n > {LEVEL_STEPS} AND seen >= 9 THEN mid END AS level,
         {local_sql(f"step * {STEP}")} // 86400 AS day,
         ({local_sql(f"step * {STEP}")} % 86400) // 900 AS slot
  FROM lv),
cells AS (
  SELECT site, variable, slot, day, quantile_cont(value - level, 0.5) AS cell FROM leveled GROUP BY ALL),
ends AS (SELECT site, variable, min(day) AS a, max(day) AS b FROM leveled GROUP BY ALL),
days AS (
  SELECT site, variable, slot, unnest(range(a, b + 1)) AS day, b
  FROM (SELECT DISTINCT site, variable, slot FROM leveled) JOIN ends USING (site, variable)),
pro AS (
  SELECT d.site, d.variable, d.slot, d.day, d.b,
         CASE WHEN count(cell) OVER q >= 3 THEN quantile_cont(cell, 0.5) OVER q ELSE 0 END AS profile,
         CASE WHEN count(cell) OVER l >= 3 THEN quantile_cont(cell, 0.5) OVER l ELSE 0 END AS latest
  FROM days d LEFT JOIN cells USING (site, variable, slot, day)
  WINDOW q AS (PARTITION BY d.site, d.variable, d.slot ORDER BY d.day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
         l AS (PARTITION BY d.site, d.variable, d.slot ORDER BY d.day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
resid AS (
  SELECT site, variable, step, value, level, profile, value - level - profile AS resid
  FROM leveled JOIN pro USING (site, variable, slot, day))"""
)

SPREAD = (
    RESID
    + """, med AS (SELECT site, variable, quantile_cont(resid, 0.5) AS m FROM resid GROUP BY ALL),
spread AS (
  SELECT site, variable, quantile_cont(abs(resid - m), 0.5) * 1.4826 AS spread,
         greatest(CASE variable WHEN 'temperature' THEN 0.1 ELSE 1.0 END,
                  0.1 * quantile_cont(abs(resid - m), 0.5) * 1.4826) AS floor
  FROM resid JOIN med USING (site, variable) GROUP BY site, variable),
zs AS (
  SELECT r.*, s.spread, s.floor, resid / greatest(spread, floor) AS z
  FROM resid r JOIN spread s USING (site, variable))"""
)

CHARTS = (
    SPREAD
    + f""", win AS (
  SELECT *, list(resid) FILTER (WHERE resid IS NOT NULL) OVER (
              PARTITION BY site, variable ORDER BY step ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS seen,
            count(*) OVER (PARTITION BY site, variable) AS n
  FROM zs),
wm AS (SELECT *, list_median(seen) AS m FROM win),
ham AS (
  SELECT site, variable, step,
         CASE WHEN resid IS NOT NULL AND n >= 13 AND len(seen) >= 10
              THEN abs(resid - m) / greatest(list_median(list_transform(seen, lambda x: abs(x - m))) * 1.4826, floor) END AS hampel
  FROM wm),
br AS (
  SELECT *, CASE WHEN lag(step) OVER s IS NULL OR step - lag(step) OVER s > 9 THEN step END AS opens
  FROM zs WHERE z IS NOT NULL WINDOW s AS (PARTITION BY site, variable ORDER BY step)),
seg AS (SELECT *, max(opens) OVER (PARTITION BY site, variable ORDER BY step) AS segment FROM br),
acc AS (
  SELECT *, sum(z - 0.5) OVER s AS up, sum(-z - 0.5) OVER s AS down, row_number() OVER s - 1 AS pos
  FROM seg WINDOW s AS (PARTITION BY site, variable, segment ORDER BY step)),
cu AS (
  SELECT *, up - least(0, min(up) OVER s) AS high, down - least(0, min(down) OVER s) AS low,
         0.2 * pow(0.8, pos) * sum(z * pow(0.8, -pos)) OVER s AS average
  FROM acc WINDOW s AS (PARTITION BY site, variable, segment ORDER BY step)),
charts AS (
  SELECT z.site, z.variable, z.step, z.value, z.resid, z.z, h.hampel,
         greatest(cu.high, cu.low) AS cusum, abs(cu.average) / sqrt(0.2 / 1.8) AS ewma
  FROM zs z JOIN ham h USING (site, variable, step) LEFT JOIN cu USING (site, variable, step))"""
)

RAINM = (
    RAIN
    + """, rm AS (
  SELECT step, coalesce(rain, 0.0) AS rain,
         sum(coalesce(rain, 0.0)) OVER (ORDER BY step RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS total,
         (step - max(CASE WHEN rain > 0.1 THEN step END) OVER (ORDER BY step)) * 2.0::DOUBLE AS dry_hours
  FROM rain),
mult AS (
  SELECT *, CASE WHEN total > 0.1 THEN 2.0 ELSE 1.0 END AS step_mode,
         CASE WHEN dry_hours IS NULL THEN 1.0
              ELSE 1.0 + (1.0 - least(greatest(dry_hours / 36.0, 0.0), 1.0)) END AS decay_mode,
         CASE WHEN total > 0.1 THEN 2.0 WHEN dry_hours IS NULL THEN 1.0
              ELSE 1.0 + (1.0 - least(greatest((dry_hours - 12.0) / 36.0, 0.0), 1.0)) END AS deployed_mode
  FROM rm)"""
)


def leveled(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with each step's level, local day and slot, and the reading above its level."""
    from sensorloom.operators import frames

    time = F.timestamp_seconds(F.col("step") * STEP)
    return stored(
        spark, ("leveled", sf),
        lambda: frames.level(series(spark, sf), KEYS, LEVEL_STEPS)
        .withColumn("day", clock.local_day(time))
        .withColumn("slot", clock.slot_of(time))
        .withColumn("above", F.col("value") - F.col("level")),
    )


def resid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with level, daily profile and residual."""
    from sensorloom.operators import frames

    def make() -> DataFrame:
        profiles, _ = frames.daily_profile(leveled(spark, sf), KEYS, "above", "day", "slot")
        return (
            leveled(spark, sf).join(profiles, [*KEYS, "slot", "day"])
            .select(*KEYS, "step", "value", "level", "profile",
                    (F.col("above") - F.col("profile")).alias("resid"))
        )

    return stored(spark, ("resid", sf), make)


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals with their sensor's spread and floor, and z."""
    from sensorloom.operators import charts

    def make() -> DataFrame:
        spread = charts.median_and_mad(resid(spark, sf), KEYS, "resid").select(
            *KEYS, F.col("sigma").alias("spread")
        )
        finest = F.when(F.col("variable") == "temperature", 0.1).otherwise(1.0)
        return (
            resid(spark, sf).join(spread, list(KEYS))
            .withColumn("floor", F.greatest(finest, F.col("spread") * 0.1))
            .withColumn("z", F.col("resid") / F.greatest("spread", "floor"))
        )

    return stored(spark, ("standardised", sf), make)


def charted(spark: SparkSession, sf: str) -> DataFrame:
    """All three control statistics at every step. Both sums run over the same stored stretches."""
    from sensorloom.operators import charts, frames
    from sensorloom.session import checkpoint

    def make() -> DataFrame:
        z = standardised(spark, sf)
        spikes = frames.hampel(z, KEYS, F.col("floor"), HAMPEL_STEPS, value="resid")
        stretches = checkpoint(charts.segments(z.select(*KEYS, "step", "z"), KEYS, "z", 8))
        sums = charts.cusum(z, KEYS, stretches=stretches).drop("high", "low")
        both = charts.ewma(z, KEYS, stretches=sums)
        at = [*KEYS, "step"]
        return spikes.select(*at, "value", "resid", "z", "hampel").join(both.select(*at, "cusum", "ewma"), at, "left")

    return stored(spark, ("charted", sf), make)


def wet(spark: SparkSession, sf: str) -> DataFrame:
    """The rain series with totals, dryness and every mode's multiplier."""
    from sensorloom.operators import rain as gate

    def make() -> DataFrame:
        out = gate.wetness(rain(spark, sf), STEP)
        total, dry = F.col("total"), F.col("dry_hours")
        return out.withColumns({
            f"{mode}_mode": gate.multiplier(mode, total, dry) for mode in ("step", "decay", "deployed")
        })

    return stored(spark, ("wet", sf), make)
