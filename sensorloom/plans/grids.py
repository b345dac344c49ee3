"""Resampling, grids, alignment and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import grid
from sensorloom.operators.scale import framed, runs
from sensorloom.plans.base import (
    DAY_US, EV, GRID, HOUR, KEYS, RAIN, SITEGRID, STEP, US, rain, readings, series, site_series,
)
from sensorloom.plans.registry import query, r6


@query("d1_grid_resample", f"""
WITH {EV}
SELECT site, variable, us // {STEP * US} AS step, r6(avg(value)) AS mean_value,
       r6(sum(value)) AS total, count(*) AS readings
FROM ev GROUP BY ALL""")
def d1(spark, sf):
    out = grid.resample(
        readings(spark, sf), KEYS, STEP,
        {"mean_value": F.avg("value"), "total": F.sum("value"), "readings": F.count("value")},
    )
    return out.withColumns({"mean_value": r6("mean_value"), "total": r6("total")})


@query("d2_complete_grid", f"WITH {GRID} SELECT site, variable, step, r6(value) AS value FROM g")
def d2(spark, sf):
    return series(spark, sf).withColumn("value", r6("value"))


@query("d3_bin_validity", f"""
WITH {EV}, bins AS (
  SELECT site, variable, us // {STEP * US} AS step, bool_or(value < 1 OR value > 300) AS bad
  FROM ev GROUP BY ALL),
spine AS (SELECT site, variable, unnest(range(a, b)) AS step FROM (
  SELECT site, variable, min(step) AS a, max(step) + 1 AS b FROM bins GROUP BY ALL))
SELECT site, variable, step, coalesce(NOT bad, true) AS valid
FROM spine LEFT JOIN bins USING (site, variable, step)""")
def d3(spark, sf):
    bad = F.bool_or((F.col("value") < 1) | (F.col("value") > 300))
    bins = grid.resample(readings(spark, sf), KEYS, STEP, {"bad": bad})
    return grid.complete(bins, KEYS).select(
        *KEYS, "step", F.coalesce(~F.col("bad"), F.lit(True)).alias("valid")
    )


@query("d4_shared_extent", f"""
WITH {EV}, per AS (SELECT site, variable, min(us) AS a, max(us) AS b FROM ev GROUP BY ALL)
SELECT max(a) AS start_us, max(b) AS end_us FROM per""")
def d4(spark, sf):
    return grid.shared_extent(readings(spark, sf), KEYS, "us").toDF("start_us", "end_us")


@query("d5_cadence", f"""
WITH {EV}, d AS (
  SELECT site, variable, us - lag(us) OVER (PARTITION BY site, variable ORDER BY us, seq) AS gap FROM ev),
m AS (SELECT site, variable, count(*) AS n, round_even(quantile_cont(gap, 0.5) / 60e6, 0) * 60 AS s
      FROM d GROUP BY ALL)
SELECT site, variable, CAST(CASE WHEN n >= 3 AND s > 0 THEN s ELSE 900 END AS BIGINT) AS seconds FROM m""")
def d5(spark, sf):
    return grid.cadence(readings(spark, sf), KEYS, 2 * 86400, 900)


@query("d9_corpus_summary", f"""
WITH {GRID}, {RAIN}, a AS (SELECT step, coalesce(rain, 0) AS mm FROM rain),
s AS (SELECT 'site' AS section, site AS item, count(value) AS rows_seen, r6(100.0 * count_if(value IS NULL OR value < 1 OR value > 300) / count(*)) AS amount, NULL::BIGINT AS first_step, NULL::BIGINT AS last_step FROM g GROUP BY site),
m AS (SELECT 'month', strftime(make_timestamp(step * {STEP * US}), '%Y-%m'), count(*), NULL::DOUBLE, min(step), max(step) FROM g GROUP BY ALL),
t AS (SELECT 'rain', 'total', count(*), r6(sum(mm)), min(step), max(step) FROM a),
w AS (SELECT step, sum(mm) OVER (ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS mm FROM a),
x AS (SELECT 'rain', 'largest 12 h', count(*), r6(max(mm)), arg_min(step, (-round(mm, 6), step)), arg_min(step, (-round(mm, 6), step)) FROM w),
e AS (SELECT 'event', 'over 5', count(*), r6(sum(mm)), min(step), max(step) FROM (SELECT *, step - row_number() OVER (ORDER BY step) AS k FROM a WHERE mm > 0) GROUP BY k HAVING sum(mm) > 5)
SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT * FROM t UNION ALL SELECT * FROM x UNION ALL SELECT * FROM e""")
def d9(spark, sf):
    """Real rows and invalid share per site, rows per month, rain total, largest 12-hour sum, rain events over 5 mm."""
    whole, value = series(spark, sf), F.col("value")
    wet = rain(spark, sf).select("step", F.coalesce("rain", F.lit(0.0)).alias("mm"))
    rolled = framed(wet, [], "step", {"sum12": lambda w: F.sum("mm").over(w.rangeBetween(-5, 0))}, before=5)
    events = runs(wet.where("mm > 0"), [], "step", lambda was, now: now - was > 1, "run").groupBy("run")
    first, last, none = F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.lit(None)
    n = F.count(F.lit(1)).alias("rows_seen")
    top = F.min_by("step", F.struct(-F.round("sum12", 6), "step"))
    parts = [
        whole.groupBy(F.lit("site").alias("section"), F.col("site").alias("item")).agg(
            F.count("value").alias("rows_seen"), r6(F.count_if(value.isNull() | (value < 1) | (value > 300)) * 100.0 / F.count(F.lit(1))).alias("amount"),
            none.cast("bigint").alias("first_step"), none.cast("bigint").alias("last_step")),
        whole.groupBy(F.lit("month").alias("section"), F.date_format(F.timestamp_seconds(F.col("step") * STEP), "yyyy-MM").alias("item")).agg(
            n, none.cast("double").alias("amount"), first, last),
        wet.groupBy(F.lit("rain").alias("section"), F.lit("total").alias("item")).agg(n, r6(F.sum("mm")).alias("amount"), first, last),
        rolled.groupBy(F.lit("rain").alias("section"), F.lit("largest 12 h").alias("item")).agg(
            n, r6(F.max("sum12")).alias("amount"), top.alias("first_step"), top.alias("last_step")),
        events.agg(n, F.sum("mm").alias("mm"), first, last).where("mm > 5").select(
            F.lit("event").alias("section"), F.lit("over 5").alias("item"), "rows_seen", r6("mm").alias("amount"), "first_step", "last_step"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("c1_asof_backward", f"""
WITH {EV}, lim AS (SELECT min(us) // {STEP * US} AS a, max(us) // {STEP * US} AS b FROM ev),
t AS (SELECT DISTINCT site, variable FROM ev),
ticks AS (SELECT site, variable, unnest(range(a, b + 1)) AS step FROM t, lim),
j AS (
  SELECT k.site, k.variable, k.step, o.value, (k.step * {STEP * US} - o.us) / {float(STEP * US)} AS age
  FROM ticks k ASOF LEFT JOIN ev o
    ON k.site = o.site AND k.variable = o.variable AND k.step * {STEP * US} >= o.us),
s AS (SELECT site, variable, avg(value) AS m, count(*) AS n FROM j GROUP BY ALL)
SELECT site, variable, step, r6(coalesce(value, m, 0)) AS value, r6(coalesce(age, n)) AS staleness
FROM j JOIN s USING (site, variable)""")
def c1(spark, sf):
    seen = readings(spark, sf)
    whole = seen.agg(
        F.min(grid.step_of("us", STEP)).alias("lo"), F.max(grid.step_of("us", STEP)).alias("hi")
    )
    # a row of the two ends beside each series, then its steps
    ticks = seen.select(*KEYS).distinct().crossJoin(F.broadcast(whole)).select(*KEYS, F.explode(F.sequence("lo", "hi")).alias("step"))
    out = grid.asof_backward(ticks, seen, KEYS, STEP)
    return out.withColumns({"value": r6("value"), "staleness": r6("staleness")})


@query("c2_asof_nearest", f"""
WITH {EV}, bins AS (SELECT site, variable, us // {STEP * US} AS step FROM ev GROUP BY ALL),
spine AS (SELECT site, variable, unnest(range(a, b)) AS step FROM (
  SELECT site, variable, min(step) AS a, max(step) + 1 AS b FROM bins GROUP BY ALL)),
near AS (
  SELECT s.site, s.variable, s.step, arg_min(o.value, (abs(o.us - s.step * {STEP * US}), o.us)) AS target
  FROM spine s JOIN ev o ON s.site = o.site AND s.variable = o.variable
   AND o.us BETWEEN s.step * {STEP * US} - {STEP * US // 2} AND s.step * {STEP * US} + {STEP * US // 2}
  GROUP BY ALL)
SELECT site, variable, step, target, target IS NOT NULL AS has_target
FROM spine LEFT JOIN near USING (site, variable, step)""")
def c2(spark, sf):
    seen = readings(spark, sf)
    steps = grid.spine(seen.select(*KEYS, grid.step_of("us", STEP).alias("step")), KEYS)
    return grid.nearest(steps, seen, KEYS, STEP, STEP / 2)


@query("c3_floored_weather_join", f"""
WITH {EV}, {RAIN}
SELECT e.seq, e.site, r6(e.value) AS value, r6(r.rain) AS rain
FROM ev e LEFT JOIN rain r ON e.us // {STEP * US} = r.step""")
def c3(spark, sf):
    stamped = readings(spark, sf).withColumn("step", grid.step_of("us", STEP))
    return stamped.join(rain(spark, sf), "step", "left").select(
        "seq", "site", r6("value").alias("value"), r6("rain").alias("rain")
    )


@query("c8_lag_by_time", f"""
WITH {GRID}
SELECT a.site, a.variable, a.step, r6(a.value) AS value, r6(b.value) AS earlier, r6(c.value) AS day_before
FROM g a LEFT JOIN g b ON a.site = b.site AND a.variable = b.variable AND b.step = a.step - 1
LEFT JOIN g c ON a.site = c.site AND a.variable = c.variable AND c.step = a.step - 12""")
def c8(spark, sf):
    from sensorloom.operators.scale import framed

    out = framed(
        series(spark, sf), KEYS, "step",
        {"earlier": lambda w: F.lag("value", 1).over(w), "day_before": lambda w: F.lag("value", 12).over(w)},
        before=12,
    )
    return out.select(*KEYS, "step", *[r6(c).alias(c) for c in ("value", "earlier", "day_before")])


@query("c11_missing_steps", f"WITH {GRID} SELECT site, variable, step FROM g WHERE value IS NULL")
def c11(spark, sf):
    seen = readings(spark, sf)
    steps = grid.spine(seen.select(*KEYS, grid.step_of("us", STEP).alias("step")), KEYS)
    return grid.missing_steps(seen, steps, KEYS, STEP)


@query("e19_fill_short_gaps", f"""
WITH {GRID}, k AS (
  SELECT *, max(CASE WHEN value IS NOT NULL THEN step END) OVER
              (PARTITION BY site, variable ORDER BY step) AS ls,
            min(CASE WHEN value IS NOT NULL THEN step END) OVER
              (PARTITION BY site, variable ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rs
  FROM g)
SELECT k.site, k.variable, k.step, r6(k.value) AS value,
       r6(CASE WHEN k.value IS NOT NULL THEN k.value
            WHEN k.step - ls <= 2 AND rs IS NOT NULL
            THEN a.value + (b.value - a.value) * ((k.step - ls) / (rs - ls)) END) AS filled
FROM k LEFT JOIN g a ON a.site = k.site AND a.variable = k.variable AND a.step = ls
LEFT JOIN g b ON b.site = k.site AND b.variable = k.variable AND b.step = rs""")
def e19(spark, sf):
    out = grid.fill_short_gaps(series(spark, sf), KEYS, 2)
    return out.select(*KEYS, "step", r6("value").alias("value"), r6("filled").alias("filled"))


@query("e24_gap_breaks", f"""
WITH {EV}, l AS (
  SELECT *, lead(us) OVER (PARTITION BY site, variable ORDER BY us, seq) AS nxt FROM ev)
SELECT site, variable, us, value FROM l
UNION ALL SELECT site, variable, us + 1, NULL FROM l WHERE nxt - us > {6 * HOUR * US}""")
def e24(spark, sf):
    return grid.break_long_gaps(readings(spark, sf), KEYS, 6 * HOUR * US, 4 * DAY_US)
