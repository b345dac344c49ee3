"""Rolling statistics, control charts and the rain gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import charts, frames, grid, rain as gate
from sensorloom.operators.scale import framed
from sensorloom.plans import base
from sensorloom.plans.base import (
    CHARTS, EV, GRID, KEYS, RAINM, RESID, SITEGRID, SPREAD, STEP, US, local_sql, series,
)
from sensorloom.plans.registry import query, r6
from sensorloom.session import level as stored

AT = [*KEYS, "step"]


@query("e1_first_and_last_per_stamp", f"""
WITH {EV}, d AS (SELECT site, variable, us // {STEP * US} AS step, us, seq, value FROM ev)
SELECT site, variable, step, arg_min(value, (us, seq)) AS first_value, arg_max(value, (us, seq)) AS last_value
FROM d GROUP BY ALL""")
def e1(spark, sf):
    placed = F.struct("us", "seq")
    return grid.resample(
        base.readings(spark, sf), KEYS, STEP,
        {"first_value": F.min_by("value", placed), "last_value": F.max_by("value", placed)},
    )


@query("e2_lookback_rain_total", f"WITH {EV}, {RAINM} SELECT step, r6(rain) AS rain, r6(total) AS total FROM rm")
def e2(spark, sf):
    return base.wet(spark, sf).select("step", r6("rain").alias("rain"), r6("total").alias("total"))


@query("e3_hours_since_wet", f"WITH {EV}, {RAINM} SELECT step, dry_hours FROM rm")
def e3(spark, sf):
    return base.wet(spark, sf).select("step", "dry_hours")


@query("e4_rain_accumulations", f"""
WITH {EV}, {RAINM},
f AS (SELECT step, last_value(rain IGNORE NULLS) OVER (ORDER BY step) AS a,
  first_value(rain IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM rain)
SELECT step, r6(sum(coalesce(a, b)) OVER (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS rain_6h,
       r6(sum(coalesce(a, b)) OVER (ORDER BY step ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) AS rain_72h
FROM f""")
def e4(spark, sf):
    filled = frames.carried_then_backfilled(base.rain(spark, sf), [], "rain")
    out = framed(
        filled, [], "step",
        {
            "rain_6h": lambda w: F.sum("filled").over(w.rowsBetween(-2, 0)),
            "rain_72h": lambda w: F.sum("filled").over(w.rowsBetween(-35, 0)),
        },
        before=36,
    )
    return out.select("step", r6("rain_6h").alias("rain_6h"), r6("rain_72h").alias("rain_72h"))


@query("e5_trailing_median", f"""
WITH {SITEGRID}
SELECT site, step, r6(quantile_cont(value, 0.5) OVER (
  PARTITION BY site ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS median FROM g""")
def e5(spark, sf):
    out = frames.trailing_median(base.site_series(spark, sf), ["site"], 8)
    return out.select("site", "step", r6("median").alias("median"))


@query("e6_trailing_level", f"WITH {RESID} SELECT site, variable, step, r6(level) AS level FROM leveled")
def e6(spark, sf):
    out = frames.level(series(spark, sf), KEYS, base.LEVEL_STEPS)
    return out.select(*AT, r6("level").alias("level"))


@query("e7_hampel", f"WITH {CHARTS} SELECT site, variable, step, r6(hampel) AS hampel FROM charts")
def e7(spark, sf):
    out = frames.hampel(base.standardised(spark, sf), KEYS, F.col("floor"), 13, value="resid")
    return out.select(*AT, r6("hampel").alias("hampel"))


@query("e8_centred_outlier", f"""
WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY us, seq) AS i FROM ev),
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY site, variable ORDER BY i
        ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING) AS m FROM n),
d AS (SELECT *, quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY site, variable ORDER BY i
        ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING) AS d FROM m)
SELECT seq, site, variable, abs(value - m) > d * (3.0 * 1.4826) AS outlier FROM d""")
def e8(spark, sf):
    from sensorloom.operators.scale import numbered

    placed = numbered(base.readings(spark, sf), KEYS, "us", "i", 4 * base.DAY_US, ("seq",))
    out = frames.centred_outlier(placed, KEYS, "i", 3.0)
    return out.select("seq", *KEYS, "outlier")


@query("e9_rolling_profile", f"""
WITH {RESID} SELECT site, variable, slot, day, r6(profile) AS profile FROM pro""")
def e9(spark, sf):
    profiles, _ = _profiles(spark, sf)
    return profiles.withColumn("profile", r6("profile"))


@query("e9_latest_profile", f"""
WITH {RESID} SELECT site, variable, slot, r6(latest) AS profile FROM pro WHERE day = b""")
def e9_latest(spark, sf):
    _, latest = _profiles(spark, sf)
    return latest.withColumn("profile", r6("profile"))


@query("d26_daily_profile_table", f"""
WITH {RESID} SELECT site, variable, slot, day, r6(cell) AS cell FROM cells""")
def d26(spark, sf):
    return (
        base.leveled(spark, sf)
        .groupBy(*KEYS, "slot", "day")
        .agg(r6(F.percentile("above", 0.5)).alias("cell"))
    )


def _profiles(spark, sf):
    return frames.daily_profile(base.leveled(spark, sf), KEYS, "above", "day", "slot")


@query("e10_x84", f"""
WITH {GRID}, w AS (
  SELECT *, list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY site, variable ORDER BY step
     ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS seen, count(*) OVER (PARTITION BY site, variable) AS n FROM g),
m AS (SELECT *, list_median(seen) AS m FROM w)
SELECT site, variable, step, CASE WHEN value IS NOT NULL AND n >= 13 THEN r6(abs(value - m) / greatest(
  list_median(list_transform(seen, lambda x: abs(x - m))), 1e-9) / 5.2) END AS x84 FROM m""")
def e10(spark, sf):
    out = frames.x84(series(spark, sf), KEYS)
    return out.select(*AT, r6("x84").alias("x84"))


@query("e20_all_usable_window", f"""
WITH {GRID}, u AS (SELECT *, value IS NOT NULL AS ok FROM g)
SELECT site, variable, step,
       min(ok::INT) OVER w = 1 AND count(*) OVER w = 5 AS whole
FROM u WINDOW w AS (PARTITION BY site, variable ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def e20(spark, sf):
    usable = series(spark, sf).withColumn("usable", F.col("value").isNotNull())
    return grid.all_usable(usable, KEYS, 4).select(*AT, "whole")


@query("e21_evenly_spread_picks", f"""
WITH {GRID}, n AS (
  SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY step) - 1 AS pos,
         count(*) OVER (PARTITION BY site, variable) AS n FROM g WHERE value IS NOT NULL),
p AS (SELECT DISTINCT site, variable, round_even(i * (n - 1) / 39.0, 0)::BIGINT AS pos
      FROM (SELECT DISTINCT site, variable, n FROM n), range(40) t(i))
SELECT n.site, n.variable, n.step FROM n JOIN p USING (site, variable, pos)""")
def e21(spark, sf):
    real = series(spark, sf).where("value IS NOT NULL")
    return frames.evenly_spread(real, KEYS, "step", 40).select(*AT)


@query("e22_clean_chunks", f"""
WITH {GRID}, ok AS (
  SELECT *, step - row_number() OVER (PARTITION BY site, variable ORDER BY step) AS grp FROM g WHERE value IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY site, variable, grp ORDER BY step) - 1 AS i FROM ok)
SELECT site, variable, min(step) AS first_step, max(step) AS last_step, count(*) AS steps
FROM p GROUP BY site, variable, grp, i // 8 HAVING count(*) >= 4""")
def e22(spark, sf):
    from sensorloom.operators.scale import numbered, runs

    real = series(spark, sf).where("value IS NOT NULL").select(*AT)
    stretches = runs(real, KEYS, "step", lambda was, now: now - was > 1)
    placed = numbered(stretches, [*KEYS, "run"], "step", "i")
    return (
        placed.groupBy(*KEYS, "run", F.floor(F.col("i") / 8).alias("chunk"))
        .agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("steps"))
        .where("steps >= 4")
        .drop("run", "chunk")
    )


@query("e25_local_slot", f"""
WITH {EV} SELECT seq, site, {local_sql(f"us // {US}")} // 86400 AS local_day,
  ({local_sql(f"us // {US}")} % 86400) // 900 AS slot FROM ev""")
def e25(spark, sf):
    from sensorloom.functions.clock import local_day, slot_of

    return base.readings(spark, sf).select(
        "seq", "site", local_day("time").alias("local_day"), slot_of("time").alias("slot")
    )


@query("e26_lag_one_autocorrelation", f"""
WITH {RESID}, l AS (SELECT *, lag(resid) OVER (PARTITION BY site, variable ORDER BY step) AS back FROM resid)
SELECT site, variable, r6(CASE WHEN count(resid) > 2 THEN corr(resid, back) ELSE 0 END) AS rho FROM l GROUP BY ALL""")
def e26(spark, sf):
    return charts.autocorrelation(base.resid(spark, sf), KEYS, "resid").withColumn("rho", r6("rho"))


@query("e27_block_split", """
WITH o AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, m % 2 = 0 AS fit_side, (m - (SELECT min(m) FROM o)) % 2 = 0 AS train_side FROM o""")
def e27(spark, sf):
    from sensorloom.sources.tables import load

    dated = load(spark, sf, "orders").select(
        "o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")
    )
    first = dated.agg(F.min("m").alias("m0"))
    return dated.crossJoin(F.broadcast(first)).select(
        "o_orderkey",
        (F.col("m") % 2 == 0).alias("fit_side"),
        ((F.col("m") - F.col("m0")) % 2 == 0).alias("train_side"),
    )


@query("e28_assign_anchors", f"""
WITH {GRID}, s AS (SELECT *, (step * {STEP} // 86400) % 8 < 4 AS train FROM g),
w AS (SELECT *, min(train::INT) OVER p AS lo, max(train::INT) OVER p AS hi, count(*) OVER p AS n
      FROM s WINDOW p AS (PARTITION BY site, variable ORDER BY step ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT site, variable, step, CASE WHEN lo = 1 THEN 'train' ELSE 'val' END AS side FROM w WHERE lo = hi AND n = 13""")
def e28(spark, sf):
    train = (F.floor(F.col("step") * STEP / 86400) % 8 < 4).cast("int")
    out = framed(
        series(spark, sf).withColumn("train", train), KEYS, "step",
        {
            "lo": lambda w: F.min("train").over(w.rowsBetween(-12, 0)),
            "hi": lambda w: F.max("train").over(w.rowsBetween(-12, 0)),
            "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-12, 0)),
        },
        before=12,
    )
    return out.where("lo = hi AND n = 13").select(
        *AT, F.when(F.col("lo") == 1, "train").otherwise("val").alias("side")
    )


@query("j1_residual", f"""
WITH {RESID} SELECT site, variable, step, r6(profile) AS profile, r6(resid) AS resid FROM resid""")
def j1(spark, sf):
    return base.resid(spark, sf).select(*AT, r6("profile").alias("profile"), r6("resid").alias("resid"))


J2_SQL = f"""{SITEGRID}, rm AS (
  SELECT *, value - quantile_cont(value, 0.5) OVER (PARTITION BY site ORDER BY step
     ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM g),
c AS (SELECT site, quantile_cont(r, 0.5) AS m FROM rm GROUP BY site),
s AS (SELECT site, greatest(1.4826 * quantile_cont(abs(r - m), 0.5), 1e-3) AS sigma FROM rm JOIN c USING (site) GROUP BY site),
x AS (SELECT site, step, coalesce(r / sigma, 0) AS x FROM rm JOIN s USING (site))"""


def _baseline(spark, sf):
    return stored(spark, ("baseline", sf), lambda: _standardise(spark, sf))


def _standardise(spark, sf):
    out = frames.trailing_median(base.site_series(spark, sf), ["site"], 8)
    out = out.withColumn("r", F.col("value") - F.col("median")).select("site", "step", "r")
    scale = charts.median_and_mad(out, ["site"], "r").select(
        "site", F.greatest("sigma", F.lit(1e-3)).alias("sigma")
    )
    return out.join(scale, "site").select(
        "site", "step", F.coalesce(F.col("r") / F.col("sigma"), F.lit(0.0)).alias("x")
    )


@query("j2_standardised_residual", f"WITH {J2_SQL} SELECT site, step, r6(x) AS x FROM x")
def j2(spark, sf):
    return _baseline(spark, sf).withColumn("x", r6("x"))


@query("j3_cusum", f"""
WITH {CHARTS} SELECT site, variable, step, r6(cusum) AS cusum FROM charts WHERE cusum IS NOT NULL""")
def j3(spark, sf):
    z = base.standardised(spark, sf).select(*AT, "z")
    return charts.cusum(z, KEYS).select(*AT, r6("cusum").alias("cusum"))


@query("j3_cusum_no_gaps", f"""
WITH {J2_SQL}, a AS (SELECT *, sum(x - 0.5) OVER w AS up, sum(-x - 0.5) OVER w AS down FROM x
  WINDOW w AS (PARTITION BY site ORDER BY step))
SELECT site, step, r6(greatest(up - least(0, min(up) OVER w), down - least(0, min(down) OVER w))) AS cusum
FROM a WINDOW w AS (PARTITION BY site ORDER BY step)""")
def j3_flat(spark, sf):
    return charts.cusum(_baseline(spark, sf), ["site"], "x", reset=None).select(
        "site", "step", r6("cusum").alias("cusum")
    )


@query("j4_ewma", f"""
WITH {CHARTS} SELECT site, variable, step, r6(ewma) AS ewma FROM charts WHERE ewma IS NOT NULL""")
def j4(spark, sf):
    z = base.standardised(spark, sf).select(*AT, "z")
    return charts.ewma(z, KEYS).select(*AT, r6("ewma").alias("ewma"))


@query("j4_ewma_exact_variance", f"""
WITH {J2_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY step) AS t FROM x)
SELECT site, step, r6(abs(0.2 * pow(0.8, t) * sum(x * pow(0.8, -t)) OVER (PARTITION BY site ORDER BY step))
  / sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * t)))) AS ewma FROM n""")
def j4_exact(spark, sf):
    out = charts.ewma(_baseline(spark, sf), ["site"], "x", reset=None, exact_variance=True)
    return out.select("site", "step", r6("ewma").alias("ewma"))


SCORES = (
    CHARTS
    + f""", {RAINM},
bases AS (
  SELECT variable, quantile_cont(hampel, 0.98) AS hb, quantile_cont(cusum, 0.98) AS cb,
         quantile_cont(ewma, 0.98) AS eb FROM charts GROUP BY ALL),
ratios AS (
  SELECT c.*, hampel / hb AS ratio, hb, cb, eb,
         lag(hampel / hb) OVER (PARTITION BY site, variable ORDER BY step) AS back
  FROM charts c JOIN bases USING (variable)),
sib AS (
  SELECT a.site, a.variable, a.step, max(b.ratio) AS siblings
  FROM ratios a LEFT JOIN ratios b ON a.site = b.site AND a.step = b.step AND a.variable <> b.variable
  GROUP BY ALL),
cor AS (
  SELECT r.*, siblings, least(ratio, greatest(back, siblings)) * hb AS spike, coalesce(deployed_mode, 1.0) AS m
  FROM ratios r JOIN sib USING (site, variable, step) LEFT JOIN mult ON mult.step = r.step),
scores AS (
  SELECT site, variable, 'hampel_spike' AS rule, step, spike AS score, hb * m AS threshold, hb AS base FROM cor
   WHERE spike IS NOT NULL
  UNION ALL SELECT site, variable, 'cusum_shift', step, cusum, cb * m, cb FROM cor WHERE cusum IS NOT NULL
  UNION ALL SELECT site, variable, 'ewma_drift', step, ewma, eb * m, eb FROM cor WHERE ewma IS NOT NULL)"""
)


@query("j5_corroborated_spike", f"""
WITH {SCORES} SELECT site, variable, step, r6(siblings) AS siblings, r6(spike) AS spike FROM cor""")
def j5(spark, sf):
    from sensorloom.operators.scoring import spikes_with_lines

    out = spikes_with_lines(base.charted(spark, sf), KEYS)
    return out.select(*AT, r6("siblings").alias("siblings"), r6("spike").alias("spike"))


def scores(spark, sf):
    from sensorloom.operators.scoring import score_rows

    return stored(
        spark, ("scores", sf), lambda: score_rows(base.charted(spark, sf), base.wet(spark, sf), KEYS)
    )


@query("j6_score_rows", f"""
WITH {SCORES} SELECT site, variable, rule, step, r6(score) AS score, r6(threshold) AS threshold, r6(base) AS base
FROM scores""")
def j6(spark, sf):
    return scores(spark, sf).withColumns({c: r6(c) for c in ("score", "threshold", "base")})


@query("j16_rain_multiplier_modes", f"""
WITH {EV}, {RAINM} SELECT step, step_mode::DOUBLE AS step_mode, r6(decay_mode) AS decay_mode, r6(deployed_mode) AS deployed_mode,
  r6(1.0 + (3.0 - 1.0) * (deployed_mode - 1.0)) AS own_node FROM mult""")
def j16(spark, sf):
    return base.wet(spark, sf).select(
        "step", "step_mode", r6("decay_mode").alias("decay_mode"), r6("deployed_mode").alias("deployed_mode"),
        r6(gate.node_multiplier(F.col("deployed_mode"), F.lit(3.0))).alias("own_node"),
    )


@query("j17_production_multiplier", f"""
WITH {EV}, {RAINM} SELECT seq, r6(coalesce(deployed_mode, 1.0)) AS multiplier, coalesce(deployed_mode, 1.0) > 1.0 AS raised
FROM ev LEFT JOIN mult ON us // {STEP * US} = step""")
def j17(spark, sf):
    stamped = base.readings(spark, sf).select("seq", grid.step_of("us", STEP).alias("step"))
    m = F.coalesce("deployed_mode", F.lit(1.0))
    return stamped.join(base.wet(spark, sf), "step", "left").select(
        "seq", r6(m).alias("multiplier"), (m > 1.0).alias("raised")
    )


@query("j18_firing_decision", f"""
WITH {CHARTS} SELECT site, variable, step, coalesce(ewma > 2.0, false) AS fired, ewma IS NOT NULL AS scorable FROM charts""")
def j18(spark, sf):
    return base.charted(spark, sf).select(
        *AT, gate.fired(F.col("ewma"), F.lit(2.0)).alias("fired"), F.col("ewma").isNotNull().alias("scorable")
    )


@query("j19_decision_record", f"""
WITH {CHARTS}, {RAINM}
SELECT site, variable, c.step, r6(ewma) AS score, 2.0::DOUBLE AS base_threshold, r6(coalesce(decay_mode, 1.0)) AS multiplier,
  r6(2.0 * coalesce(decay_mode, 1.0)) AS threshold, dry_hours AS hours_since_wet, 'decay' AS mode,
  coalesce(ewma > 2.0 * coalesce(decay_mode, 1.0), false) AS fired, ewma IS NOT NULL AS scorable
FROM charts c LEFT JOIN mult m ON m.step = c.step""")
def j19(spark, sf):
    m = F.coalesce("decay_mode", F.lit(1.0))
    joined = base.charted(spark, sf).join(
        base.wet(spark, sf).select("step", "decay_mode", "dry_hours"), "step", "left"
    )
    return joined.select(
        *AT, r6("ewma").alias("score"), F.lit(2.0).alias("base_threshold"), r6(m).alias("multiplier"),
        r6(m * 2.0).alias("threshold"), F.col("dry_hours").alias("hours_since_wet"), F.lit("decay").alias("mode"),
        gate.fired(F.col("ewma"), m * 2.0).alias("fired"), F.col("ewma").isNotNull().alias("scorable"),
    )
