"""Forecast channels, nulls, tails, rules and calibration (P, J7-J15, J20-J22, K, D10-D19, I7-I14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import stats
from sensorloom.operators import charts, forecast, grid, rules, tails
from sensorloom.operators.scale import framed, numbered, prefix, quantiles, runs
from sensorloom.plans import base
from sensorloom.plans.base import CHARTS, EV, GRID, KEYS, RAINM, RESID, SITEGRID, STEP, series
from sensorloom.plans.charts import SCORES, scores
from sensorloom.plans.registry import query, r6
from sensorloom.session import level as stored

AT = [*KEYS, "step"]

FC = (
    GRID
    + """, fc0 AS (
  SELECT *, last_value(value IGNORE NULLS) OVER w AS pred,
         step - max(CASE WHEN value IS NOT NULL THEN step END) OVER w AS age,
         lag(value, 12) OVER (PARTITION BY site, variable ORDER BY step) AS diurnal,
         sum(value) OVER (PARTITION BY site, step) AS tot, count(value) OVER (PARTITION BY site, step) AS cnt
  FROM g WINDOW w AS (PARTITION BY site, variable ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fc1 AS (SELECT *, CASE WHEN cnt - (value IS NOT NULL)::INT > 0
          THEN (tot - coalesce(value, 0)) / (cnt - (value IS NOT NULL)::INT) END AS loo FROM fc0),
sc AS (SELECT site, variable, greatest(stddev_pop(value - pred), 0.01) AS scale,
              greatest(stddev_pop(value - loo), 0.01) AS loo_scale FROM fc1 GROUP BY ALL),
fc AS (SELECT f.*, s.scale, s.loo_scale FROM fc1 f JOIN sc s USING (site, variable))"""
)


def forecasts(spark, sf):
    def make():
        out = forecast.persistence(series(spark, sf), KEYS, 12)
        out = forecast.leave_one_out(out, ["site", "step"])
        spread = out.groupBy(*KEYS).agg(
            F.greatest(F.stddev_pop(F.col("value") - F.col("pred")), F.lit(0.01)).alias("scale"),
            F.greatest(F.stddev_pop(F.col("value") - F.col("loo")), F.lit(0.01)).alias("loo_scale"),
        )
        return out.join(spread, list(KEYS))

    return stored(spark, ("forecasts", sf), make)


@query("p4_forecast_baselines", f"""
WITH {FC} SELECT site, variable, step, r6(pred) AS persistence, age, r6(diurnal) AS diurnal FROM fc""")
def p4(spark, sf):
    return forecasts(spark, sf).select(*AT, r6("pred").alias("persistence"), "age", r6("diurnal").alias("diurnal"))


@query("p4_autoregression", f"""
WITH {GRID}, l AS (SELECT *, lag(value) OVER (PARTITION BY site, variable ORDER BY step) AS lag1 FROM g),
f AS (SELECT site, variable, regr_slope(value, lag1) AS a, regr_intercept(value, lag1) AS b FROM l GROUP BY ALL)
SELECT site, variable, step, r6(a * lag1 + b) AS pred FROM l JOIN f USING (site, variable)""")
def p4_ar(spark, sf):
    return forecast.autoregression(series(spark, sf), KEYS).select(*AT, r6("pred").alias("pred"))


@query("p5_leave_one_out_forecast", f"WITH {FC} SELECT site, variable, step, r6(loo) AS loo FROM fc")
def p5(spark, sf):
    return forecasts(spark, sf).select(*AT, r6("loo").alias("loo"))


@query("p6_predicted_scale", f"""
WITH {FC} SELECT site, variable, least(age, 4) AS staleness, r6(greatest(stddev_pop(value - pred), 0.01)) AS scale
FROM fc WHERE value IS NOT NULL AND age IS NOT NULL GROUP BY ALL""")
def p6(spark, sf):
    aged = forecasts(spark, sf).where("value IS NOT NULL AND age IS NOT NULL").withColumn(
        "staleness", F.least("age", F.lit(4))
    )
    out = forecast.scale_by(aged, [*KEYS, "staleness"], F.col("value") - F.col("pred"))
    return out.withColumn("scale", r6("scale"))


CHANNELS = (
    FC
    + """, ch AS (
  SELECT *, CASE WHEN age <= 4 THEN abs(value - pred) / scale END AS excursion,
         abs(value - loo) / loo_scale AS loo_channel,
         avg(abs(value - pred) / scale) OVER (PARTITION BY site, variable ORDER BY step ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS reconstruction,
         CASE WHEN count(value) OVER c >= 4 THEN greatest(ln(greatest(scale, 1e-3) /
           greatest(stddev_pop(coalesce(value, pred)) OVER c, 1e-3)), 0) END AS dispersion
  FROM fc WINDOW c AS (PARTITION BY site, variable ORDER BY step ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""
)


def channels(spark, sf):
    return stored(spark, ("channels", sf), lambda: forecast.channels(forecasts(spark, sf), KEYS))


for _id, _name in (("j7", "excursion"), ("j8", "loo_channel"), ("j9", "reconstruction"), ("j10", "dispersion")):

    @query(f"{_id}_{_name}", f"WITH {CHANNELS} SELECT site, variable, step, r6({_name}) AS {_name} FROM ch")
    def channel(spark, sf, _name=_name):
        return channels(spark, sf).select(*AT, r6(_name).alias(_name))


CLEANSTEPS = f"""{RAINM}, sp(a, b) AS (VALUES (0, 24), (60, 96)), zero AS (SELECT min(step) AS z0 FROM g),
cl AS (SELECT g.site, g.variable, g.step, NOT EXISTS (SELECT 1 FROM sp, zero WHERE g.step >= z0 + a AND g.step < z0 + b)
  AND coalesce(decay_mode, 1.0) <= 1.0 + 1e-9 AS clean, (g.step * {STEP} // 86400) % 2 = 0 AS fit
  FROM g LEFT JOIN mult ON g.step = mult.step)"""
NULLS = (
    f"{CHANNELS}, {CLEANSTEPS}"
    + """, long AS (SELECT site, variable, step, channel, round(score, 9) AS score FROM ch
   UNPIVOT (score FOR channel IN (excursion, loo_channel, reconstruction, dispersion))),
samples AS (SELECT channel, score FROM long JOIN cl USING (site, variable, step) WHERE clean AND fit),
us AS (SELECT channel, count(*) AS n, quantile_cont(score, 0.95) AS u FROM samples GROUP BY channel),
tl AS (SELECT channel, n, u, avg(score - u) AS sigma, count(*) / n AS tail_p FROM samples JOIN us USING (channel)
       WHERE score > u GROUP BY channel, n, u),
ranked AS (
  SELECT *, sum(kind) OVER (PARTITION BY channel ORDER BY score, kind ROWS UNBOUNDED PRECEDING) AS below
  FROM (SELECT site, variable, step, channel, score, 0 AS kind FROM long
        UNION ALL SELECT NULL, NULL, NULL, channel, score, 1 FROM samples)),
pv AS (
  SELECT site, variable, step, channel, score,
    CASE WHEN score > u THEN greatest(tail_p * exp(-(score - u) / sigma), 1e-300) ELSE (1.0 + n - below) / (1.0 + n) END AS p
  FROM ranked JOIN tl USING (channel) WHERE kind = 0)"""
)


def long_channels(spark, sf):
    return channels(spark, sf).select(*AT, "excursion", "loo_channel", "reconstruction", "dispersion").unpivot(
        AT, ["excursion", "loo_channel", "reconstruction", "dispersion"], "channel", "score"
    ).where("score IS NOT NULL").withColumn("score", F.round("score", 9))


def null_samples(spark, sf):
    """Scores of all clean steps on the fit side of the split."""
    return long_channels(spark, sf).join(fit_steps(spark, sf), AT, "left_semi").select("channel", "score")


def pvals(spark, sf):
    """P-values against all clean fit-side steps, with exponential tails above the 95th percentile."""
    def make():
        samples = null_samples(spark, sf)
        marks = quantiles(samples, ["channel"], "score", {"u": 0.95}, count="n")
        fit = (
            samples.join(marks, "channel").where("score > u").groupBy("channel", "n", "u")
            .agg(F.avg(F.col("score") - F.col("u")).alias("sigma"), (F.count(F.lit(1)) / F.first("n")).alias("tail_p"))
            .withColumn("gamma", F.lit(0.0))
        )
        return tails.pvalues(long_channels(spark, sf), samples, fit, ["channel"], "score", 0.05)

    return stored(spark, ("pvals", sf), make)


@query("j11_pvalue_against_null", f"""
WITH {NULLS} SELECT site, variable, step, channel, r6(p) AS p FROM pv""")
def j11(spark, sf):
    return pvals(spark, sf).select(*AT, "channel", r6("p").alias("p"))


@query("j12_combine_channels", f"""
WITH {NULLS} SELECT site, variable, step, r6(sum(-2 * ln(greatest(p, 1e-300)))) AS fisher, count(*) AS channels,
  r6(max(score)) AS largest FROM pv GROUP BY ALL""")
def j12(spark, sf):
    p = pvals(spark, sf)
    return tails.fisher(p, AT).join(p.groupBy(*AT).agg(F.max("score").alias("largest")), AT).select(
        *AT, r6("fisher").alias("fisher"), "channels", r6("largest").alias("largest")
    )


@query("i8_chi_square_survival", f"""
WITH {NULLS}, f AS (SELECT site, variable, step, sum(-2 * ln(greatest(p, 1e-300))) AS s, count(*) AS k FROM pv GROUP BY ALL)
SELECT site, variable, step, r6(least(exp(-s / 2) * (1 + CASE WHEN k > 1 THEN s / 2 ELSE 0 END
  + CASE WHEN k > 2 THEN s * s / 8 ELSE 0 END + CASE WHEN k > 3 THEN s * s * s / 48 ELSE 0 END), 1.0)) AS p FROM f""")
def i8(spark, sf):
    f = tails.fisher(pvals(spark, sf), AT)
    return f.select(*AT, r6(stats.chi2_sf_even(F.col("fisher"), F.col("channels"))).alias("p"))


@query("k6_channel_null_fit")
def k6(spark, sf):
    return tails.fit_null(null_samples(spark, sf), ["channel"], "score")


STATLONG = f"""{CHARTS}, stat AS (SELECT site, variable, step, rule, stat FROM charts
  UNPIVOT (stat FOR rule IN (hampel, cusum, ewma)))"""


def long_stats(spark, sf):
    return base.charted(spark, sf).select(*AT, "hampel", "cusum", "ewma").unpivot(
        AT, ["hampel", "cusum", "ewma"], "rule", "stat"
    ).where("stat IS NOT NULL")


def fit_stats(spark, sf):
    """The control statistics of all clean steps on the fit side of the split."""
    return long_stats(spark, sf).join(fit_steps(spark, sf), AT, "left_semi")


@query("k1_clusters", f"""
WITH {STATLONG}, h AS (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY site, variable, rule ORDER BY step) <= 8
   THEN 0 ELSE 1 END AS opens FROM stat WHERE stat > 2.5),
c AS (SELECT *, sum(opens) OVER (PARTITION BY site, variable, rule ORDER BY step) AS k FROM h)
SELECT site, variable, rule, min(step) AS first_step, max(step) AS last_step, r6(max(stat)) AS peak, count(*) AS steps
FROM c GROUP BY site, variable, rule, k""")
def k1(spark, sf):
    hits = long_stats(spark, sf).where("stat > 2.5")
    return tails.clusters(hits, [*KEYS, "rule"], "stat").withColumn("peak", r6("peak"))


LADDER = f"""{CHARTS}, {CLEANSTEPS}, stat AS (SELECT s.* FROM (SELECT site, variable, step, rule, stat FROM charts
  UNPIVOT (stat FOR rule IN (hampel, cusum, ewma))) s JOIN cl USING (site, variable, step) WHERE clean AND fit), lev(i, p) AS (VALUES (0, 98.0), (1, 95.0), (2, 90.0), (3, 85.0), (4, 80.0)),
ts AS (SELECT variable, rule, i, p, count(stat) AS n, any_value(CASE i WHEN 0 THEN q98 WHEN 1 THEN q95 WHEN 2 THEN q90 WHEN 3 THEN q85 ELSE q80 END) AS t
  FROM stat JOIN (SELECT variable, rule, quantile_cont(stat, 0.98) AS q98, quantile_cont(stat, 0.95) AS q95,
    quantile_cont(stat, 0.90) AS q90, quantile_cont(stat, 0.85) AS q85, quantile_cont(stat, 0.80) AS q80 FROM stat GROUP BY ALL)
  USING (variable, rule), lev GROUP BY variable, rule, i, p),
hh AS (SELECT s.*, ts.i, ts.p, ts.t, ts.n, CASE WHEN step - lag(step) OVER (PARTITION BY site, s.variable, s.rule, i ORDER BY step) <= 8
   THEN 0 ELSE 1 END AS opens FROM stat s JOIN ts USING (variable, rule) WHERE stat > t),
kk AS (SELECT *, sum(opens) OVER (PARTITION BY site, variable, rule, i ORDER BY step) AS k FROM hh),
pk AS (SELECT site, variable, rule, i, p, t, n, k, max(stat) AS peak FROM kk GROUP BY ALL),
ct AS (SELECT variable, rule, i, p, t, n, count(*) AS n_t FROM pk GROUP BY ALL HAVING count(*) >= 20),
best AS (SELECT variable, rule, min(i) AS i FROM ct GROUP BY ALL),
tail AS (SELECT ct.* FROM ct JOIN best USING (variable, rule, i))"""


def pooled_ladder(spark, sf):
    """Tails shared by the sensors of a kind: clusters stay inside a sensor, levels are the kind's."""
    pooled = fit_stats(spark, sf)
    levels = quantiles(pooled, ["variable", "rule"], "stat",
                       {f"_p{i}": p / 100.0 for i, p in enumerate(tails.LADDER)}, count="n")
    rows = F.array(*[
        F.struct(F.lit(i).alias("_rank"), F.lit(p).alias("percentile"), F.col(f"_p{i}").alias("t"))
        for i, p in enumerate(tails.LADDER)
    ])
    tried = levels.select("variable", "rule", "n", F.inline(rows))
    hits = pooled.join(tried, ["variable", "rule"]).where("stat > t")
    peaks = tails.clusters_with(hits, [*KEYS, "rule", "_rank"], "stat", 8, ["percentile", "t", "n"])
    counted = peaks.groupBy("variable", "rule", "_rank", "percentile", "t", "n").agg(F.count(F.lit(1)).alias("n_t"))
    best = (
        counted.where(F.col("n_t") >= tails.MIN_CLUSTERS).groupBy("variable", "rule")
        .agg(F.min_by(F.struct("percentile", "t", "n", "n_t", "_rank"), "_rank").alias("b"))
        .select("variable", "rule", "b.*")
    )
    excess = peaks.join(best.select("variable", "rule", "_rank"), ["variable", "rule", "_rank"]).select(
        "variable", "rule", (F.col("peak") - F.col("t")).alias("excess")
    )
    return best.drop("_rank"), excess


@query("k2_percentile_ladder", f"""
WITH {LADDER} SELECT variable, rule, p::DOUBLE AS percentile, r6(t) AS t, n, n_t FROM tail""")
def k2(spark, sf):
    best, _ = pooled_ladder(spark, sf)
    return best.withColumn("t", r6("t"))


def pooled_tails(spark, sf):
    def make():
        best, excess = pooled_ladder(spark, sf)
        excess = stored(spark, ("excess", sf), lambda: excess)
        fit = tails.fit_gpd(excess, ["variable", "rule"], bounded=True).select("variable", "rule", "sigma", "gamma")
        return best.join(fit, ["variable", "rule"])

    return stored(spark, ("pooled_tails", sf), make)


@query("k3_gpd_fit")
def k3(spark, sf):
    pooled_tails(spark, sf)
    _, excess = pooled_ladder(spark, sf)
    excess = stored(spark, ("excess", sf), lambda: excess)
    return tails.fit_gpd(excess, ["variable", "rule"])


@query("k4_gpd_fit_bounded")
def k4(spark, sf):
    return pooled_tails(spark, sf).select("variable", "rule", "sigma", "gamma")


@query("k5_peaks_over_threshold")
def k5(spark, sf):
    return tails.pot(fit_stats(spark, sf), ["variable", "rule"], "stat", 1e-3)


@query("k7_own_or_pooled_tail")
def k7(spark, sf):
    own, excess = tails.ladder(fit_stats(spark, sf), [*KEYS, "rule"], "stat")
    excess = stored(spark, ("own_excess", sf), lambda: excess)
    fit = tails.fit_gpd(excess, [*KEYS, "rule"], bounded=True).select(*KEYS, "rule", "sigma", "gamma")
    mine = own.join(fit, [*KEYS, "rule"]).withColumn("pooled", F.lit(False))
    shared = pooled_tails(spark, sf).withColumn("pooled", F.lit(True))
    cols = ("percentile", "t", "n", "n_t", "sigma", "gamma", "pooled")
    wanted = long_stats(spark, sf).select(*KEYS, "rule").distinct()
    return (
        wanted.join(mine.select(*KEYS, "rule", F.struct(*cols).alias("a")), [*KEYS, "rule"], "left")
        .join(shared.select("variable", "rule", F.struct(*cols).alias("b")), ["variable", "rule"], "left")
        .select(*KEYS, "rule", F.coalesce("a", "b").alias("tail"))
        .where("tail IS NOT NULL").select(*KEYS, "rule", "tail.*")
    )


@query("k13_sensitivity_stops")
def k13(spark, sf):
    stops = {"far_fewer": 1e-5, "fewer": 3e-5, "calibrated": 1e-4, "more": 3e-4, "far_more": 1e-3}
    return tails.thresholds_for_rates(pooled_tails(spark, sf), stops).select(
        "variable", "rule", "stop", "rate", "threshold"
    )


@query("i10_tail_and_rate_inversion", f"""
WITH {STATLONG}, u AS (SELECT variable, rule, count(*) AS n, quantile_cont(stat, 0.9) AS t FROM stat GROUP BY ALL),
e AS (SELECT variable, rule, n, t, avg(stat - t) AS sigma, count(*) AS n_t FROM stat JOIN u USING (variable, rule)
      WHERE stat > t GROUP BY variable, rule, n, t)
SELECT variable, rule, r6(t - sigma * ln(1e-4 * n / n_t)) AS exponential_line,
  r6(t + sigma / 0.1 * (pow(1e-4 * n / n_t, -0.1) - 1)) AS heavy_line,
  r6(n_t / n * exp(-3.0 / sigma)) AS exponential_rate, r6(n_t / n * pow(1 + 0.1 * 3.0 / sigma, -10.0)) AS heavy_rate,
  r6(exp(-3.0 / sigma)) AS survival FROM e""")
def i10(spark, sf):
    long = long_stats(spark, sf)
    marks = quantiles(long, ["variable", "rule"], "stat", {"t": 0.9}, count="n")
    e = (
        long.join(marks, ["variable", "rule"]).where("stat > t").groupBy("variable", "rule", "n", "t")
        .agg(F.avg(F.col("stat") - F.col("t")).alias("sigma"), F.count(F.lit(1)).alias("n_t"))
    )
    t, sigma, ratio, share = F.col("t"), F.col("sigma"), F.lit(1e-4) * F.col("n") / F.col("n_t"), F.col("n_t") / F.col("n")
    none, heavy = F.lit(0.0), F.lit(0.1)
    return e.select(
        "variable", "rule",
        r6(stats.threshold_for(t, sigma, none, ratio)).alias("exponential_line"),
        r6(stats.threshold_for(t, sigma, heavy, ratio)).alias("heavy_line"),
        r6(stats.rate_for(t, sigma, none, share, t + 3.0)).alias("exponential_rate"),
        r6(stats.rate_for(t, sigma, heavy, share, t + 3.0)).alias("heavy_rate"),
        r6(stats.gpd_sf(t + 3.0, t, sigma, none)).alias("survival"),
    )


@query("i9_gpd_survival", f"""
WITH {STATLONG} SELECT site, variable, step, rule, r6(CASE WHEN stat <= 1 THEN 1.0 ELSE exp(-(stat - 1) / 2) END) AS flat,
  r6(CASE WHEN stat <= 1 THEN 1.0 ELSE pow(1 + 0.2 * (stat - 1) / 2, -5.0) END) AS heavy,
  r6(CASE WHEN stat <= 1 THEN 1.0 WHEN 1 - 0.2 * (stat - 1) / 2 > 0 THEN pow(1 - 0.2 * (stat - 1) / 2, 5.0) ELSE 0 END) AS ending
FROM stat""")
def i9(spark, sf):
    x, one, two = F.col("stat"), F.lit(1.0), F.lit(2.0)
    return long_stats(spark, sf).select(
        *AT, "rule", r6(stats.gpd_sf(x, one, two, F.lit(0.0))).alias("flat"),
        r6(stats.gpd_sf(x, one, two, F.lit(0.2))).alias("heavy"), r6(stats.gpd_sf(x, one, two, F.lit(-0.2))).alias("ending"),
    )


@query("i11_long_run_factor", f"""
WITH {RESID}, l AS (SELECT *, lag(resid) OVER (PARTITION BY site, variable ORDER BY step) AS back FROM resid),
r AS (SELECT site, variable, CASE WHEN count(resid) > 2 THEN corr(resid, back) ELSE 0 END AS rho FROM l GROUP BY ALL)
SELECT site, variable, r6(sqrt((1 + least(greatest(rho, 0), 0.995)) / (1 - least(greatest(rho, 0), 0.995)))) AS factor FROM r""")
def i11(spark, sf):
    rho = charts.autocorrelation(base.resid(spark, sf), KEYS, "resid")
    return rho.select(*KEYS, r6(stats.long_run_factor(F.col("rho"))).alias("factor"))


@query("k8_clean_mask", f"""
WITH {GRID}, {RAINM}, sp(a, b) AS (VALUES (0, 24), (60, 96)), z AS (SELECT min(step) AS z FROM g)
SELECT g.site, g.variable, g.step, NOT EXISTS (SELECT 1 FROM sp, z WHERE g.step >= z + a AND g.step < z + b)
  AND coalesce(decay_mode, 1.0) <= 1.0 + 1e-9 AS clean FROM g LEFT JOIN mult ON g.step = mult.step""")
def k8(spark, sf):
    return clean(spark, sf).select(*AT, "clean")


def clean(spark, sf):
    """The grid with its fault-free mask: outside two labelled spans and with the gate not raised."""
    def make():
        whole = series(spark, sf)
        zero = whole.agg(F.min("step").alias("z"))
        spans = spark.createDataFrame([(0, 24), (60, 96)], "a bigint, b bigint").crossJoin(zero).select(
            (F.col("a") + F.col("z")).alias("lo"), (F.col("b") + F.col("z")).alias("hi")
        )
        return rules.clean_mask(whole, spans, base.wet(spark, sf))

    return stored(spark, ("clean", sf), make)


def fit_steps(spark, sf):
    """Clean steps of every other day, the side that calibration is fitted on."""
    return clean(spark, sf).where(F.col("clean") & (F.floor(F.col("step") * STEP / 86400) % 2 == 0)).select(*AT)


CLEAN = f"{CHARTS}, {CLEANSTEPS}"


@query("k9_sensor_preparation", f"""
WITH {CLEAN}, r AS (SELECT z.*, clean AND fit AND resid IS NOT NULL AS f FROM zs z JOIN cl USING (site, variable, step)),
m AS (SELECT site, variable, quantile_cont(resid, 0.5) AS m, count(*) / 12.0 AS days FROM r WHERE f GROUP BY ALL)
SELECT site, variable, r6(days) AS clean_days, r6(quantile_cont(abs(resid - m), 0.5) * 1.4826) AS spread
FROM r JOIN m USING (site, variable) WHERE f AND days >= 4 GROUP BY site, variable, days""")
def k9(spark, sf):
    fit = (F.floor(F.col("step") * STEP / 86400) % 2 == 0)
    fitted = base.resid(spark, sf).join(clean(spark, sf).select(*AT, "clean"), AT).where(F.col("clean") & fit & F.col("resid").isNotNull())
    days = fitted.groupBy(*KEYS).agg((F.count(F.lit(1)) / 12.0).alias("clean_days")).where("clean_days >= 4")
    spread = charts.median_and_mad(fitted, KEYS, "resid")
    return days.join(spread, list(KEYS)).select(
        *KEYS, r6("clean_days").alias("clean_days"), r6("sigma").alias("spread")
    )


@query("k10_held_out_check", f"""
WITH {CLEAN}, st AS (SELECT s.*, fit FROM (SELECT site, variable, step, rule, stat FROM charts UNPIVOT (stat FOR rule IN (hampel, cusum, ewma))) s
  JOIN cl USING (site, variable, step) WHERE clean),
ln AS (SELECT variable, rule, quantile_cont(stat, 0.98) AS line FROM st WHERE fit GROUP BY ALL),
hd AS (SELECT st.*, stat > line AS over_line FROM st JOIN ln USING (variable, rule) WHERE NOT fit),
op AS (SELECT *, CASE WHEN step - lag(step) OVER (PARTITION BY site, variable, rule ORDER BY step) <= 8 THEN 0 ELSE 1 END AS opens
       FROM hd WHERE over_line),
jd AS (SELECT rule, count(*) AS judged FROM hd GROUP BY rule), al AS (SELECT rule, sum(opens) AS alarms FROM op GROUP BY rule)
SELECT rule, coalesce(alarms, 0)::BIGINT AS alarms, judged, r6(coalesce(alarms, 0) / judged) AS rate,
  coalesce(alarms, 0) / judged <= 2 * 0.02 AS passed FROM jd LEFT JOIN al USING (rule)""")
def k10(spark, sf):
    side = (F.floor(F.col("step") * STEP / 86400) % 2 == 0).alias("fit")
    st = long_stats(spark, sf).join(clean(spark, sf).select(*AT, "clean"), AT).where("clean").select("*", side)
    lines = quantiles(st.where("fit"), ["variable", "rule"], "stat", {"line": 0.98})
    held = st.where("NOT fit").join(lines, ["variable", "rule"])
    return rules.held_out(held, [*KEYS, "rule"], "rule", 0.02).withColumn("rate", r6("rate"))


@query("k11_refit_calibration", f"""
WITH {CLEAN}, kept AS (SELECT g.* FROM g JOIN cl USING (site, variable, step) WHERE clean AND g.value IS NOT NULL),
f AS (SELECT site, variable, count(*) AS steps, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM kept GROUP BY ALL),
a AS (SELECT site, variable, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM g GROUP BY ALL)
SELECT a.site, a.variable, coalesce(f.steps >= 96, false) AS refitted, r6(CASE WHEN f.steps >= 96 THEN f.m ELSE a.m END) AS median,
  r6(CASE WHEN f.steps >= 96 THEN f.i ELSE a.i END) AS iqr FROM a LEFT JOIN f USING (site, variable)""")
def k11(spark, sf):
    return rules.refit(series(spark, sf), clean(spark, sf), KEYS, 96).withColumns(
        {"median": r6("median"), "iqr": r6("iqr")}
    )


@query("k12_refit_null_and_line")
def k12(spark, sf):
    """Nulls and the alert line refitted on all fault-free anchors."""
    usable = grid.all_usable(clean(spark, sf).withColumn("usable", F.col("clean")), KEYS, 4).where("whole")
    fisher = tails.fisher(pvals(spark, sf), AT).join(usable.select(*AT), AT, "left_semi")
    return tails.pot(fisher.withColumn("model", F.lit("channels")), ["model"], "fisher", 1e-3)


@query("d10_node_scaler", f"""
WITH {GRID} SELECT site, variable, r6(CASE WHEN count(value) >= 2 THEN avg(value) ELSE 0 END) AS mean,
  r6(CASE WHEN count(value) >= 2 THEN greatest(stddev_pop(value), 1e-3) ELSE 1 END) AS std FROM g GROUP BY site, variable""")
def d10(spark, sf):
    enough = F.count("value") >= 2
    return series(spark, sf).groupBy(*KEYS).agg(
        r6(F.when(enough, F.avg("value")).otherwise(0.0)).alias("mean"),
        r6(F.when(enough, F.greatest(F.stddev_pop("value"), F.lit(1e-3))).otherwise(1.0)).alias("std"),
    )


WIDE = f"""{GRID}, w AS (SELECT site, step, max(CASE WHEN variable = 'conductivity' THEN value END) AS a,
  max(CASE WHEN variable = 'depth' THEN value END) AS b, max(CASE WHEN variable = 'temperature' THEN value END) AS c FROM g GROUP BY ALL)"""


@query("d11_feature_scaler", f"""
WITH {WIDE}, k AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
s AS (SELECT avg(a) AS ma, CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END AS sa FROM k)
SELECT site, step, r6((a - ma) / sa) AS scaled, r6((a - ma) / sa * sa + ma) AS restored FROM w, s""")
def d11(spark, sf):
    wide = series(spark, sf).groupBy("site", "step").pivot("variable", ["conductivity", "depth", "temperature"]).agg(F.first("value"))
    fit = wide.dropna(subset=["conductivity", "depth", "temperature"]).agg(
        F.avg("conductivity").alias("m"), F.stddev_pop("conductivity").alias("d")
    ).select("m", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("s"))
    scaled = (F.col("conductivity") - F.col("m")) / F.col("s")
    return wide.crossJoin(F.broadcast(fit)).select(
        "site", "step", r6(scaled).alias("scaled"), r6(scaled * F.col("s") + F.col("m")).alias("restored")
    )


@query("d12_context_scaler", f"""
WITH {EV}, {RAINM}, x AS (SELECT step, ln(1 + greatest(rain, 0)) AS x FROM rain WHERE rain IS NOT NULL),
s AS (SELECT avg(x) AS m, greatest(stddev_pop(x), 1e-3) AS s FROM x) SELECT step, r6((x - m) / s) AS scaled FROM x, s""")
def d12(spark, sf):
    x = base.rain(spark, sf).where("rain IS NOT NULL").select("step", F.log1p(F.greatest("rain", F.lit(0.0))).alias("x"))
    fit = x.agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(1e-3)).alias("s"))
    return x.crossJoin(F.broadcast(fit)).select("step", r6((F.col("x") - F.col("m")) / F.col("s")).alias("scaled"))


@query("d13_robust_centre_and_spread", """
SELECT l_returnflag, r6(quantile_cont(l_extendedprice, 0.5)) AS median, r6(CASE WHEN quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) > 1e-6
  THEN quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) ELSE 1 END) AS iqr FROM lineitem GROUP BY l_returnflag""")
def d13(spark, sf):
    from sensorloom.sources.tables import load

    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    q = quantiles(lines, ["l_returnflag"], "l_extendedprice", {"a": 0.25, "median": 0.5, "b": 0.75})
    iqr = F.col("b") - F.col("a")
    return q.select("l_returnflag", r6("median").alias("median"), r6(F.when(iqr > 1e-6, iqr).otherwise(1.0)).alias("iqr"))


@query("d14_mad_sigma", f"""
WITH {EV}, m AS (SELECT site, quantile_cont(value, 0.5) AS m FROM ev GROUP BY site)
SELECT site, r6(m) AS median, r6(quantile_cont(abs(value - m), 0.5) * 1.4826) AS sigma FROM ev JOIN m USING (site) GROUP BY site, m""")
def d14(spark, sf):
    out = charts.median_and_mad(base.readings(spark, sf), ["site"], "value")
    return out.withColumns({"median": r6("median"), "sigma": r6("sigma")})


@query("d15_masked_mean", f"""
WITH {GRID} SELECT step, round(avg(CASE WHEN variable <> 'depth' THEN value END), 9) AS masked,
  round(coalesce(avg(CASE WHEN variable <> 'depth' THEN value END), avg(value)), 9) AS pooled FROM g GROUP BY step""")
def d15(spark, sf):
    kept = F.avg(F.when(F.col("variable") != "depth", F.col("value")))
    return series(spark, sf).groupBy("step").agg(
        F.round(kept, 9).alias("masked"), F.round(F.coalesce(kept, F.avg("value")), 9).alias("pooled")
    )


@query("d16_empirical_threshold", """
SELECT l_shipmode AS mode, r6(q) AS line FROM (SELECT l_returnflag AS l_shipmode, quantile_cont(l_extendedprice, 0.99) AS q FROM lineitem GROUP BY 1
UNION ALL SELECT '__all__', quantile_cont(l_extendedprice, 0.99) FROM lineitem)""")
def d16(spark, sf):
    from sensorloom.sources.tables import load

    lines = load(spark, sf, "lineitem").select(
        F.explode(F.array("l_returnflag", F.lit("__all__"))).alias("mode"), "l_extendedprice"
    )
    return quantiles(lines, ["mode"], "l_extendedprice", {"line": 0.99}).withColumn("line", r6("line"))


@query("d17_coverage", f"""
WITH {GRID} SELECT step, r6(avg((value IS NOT NULL)::INT)) AS coverage FROM g GROUP BY step""")
def d17(spark, sf):
    return series(spark, sf).groupBy("step").agg(r6(F.avg(F.col("value").isNotNull().cast("int"))).alias("coverage"))


NOTICE = f"""{SCORES}, no AS (SELECT site, variable, rule, min(CASE WHEN score > threshold THEN step END) AS first_over,
  max(CASE WHEN score > threshold THEN step END) AS last_over, max(score) AS peak,
  arg_min(base, step) FILTER (WHERE score > threshold) AS base, count_if(score > threshold) AS steps_over
  FROM scores GROUP BY ALL HAVING count_if(score > threshold) >= 1)"""


@query("d18_notice_groups", f"""
WITH {NOTICE} SELECT site, variable, rule, first_over, last_over, r6(peak) AS peak, r6(base) AS base, steps_over FROM no""")
def d18(spark, sf):
    return rules.notice(scores(spark, sf), [*KEYS, "rule"]).withColumns({"peak": r6("peak"), "base": r6("base")})


@query("d19_longest_run", f"""
WITH {SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY site, variable, rule ORDER BY step) AS n FROM scores),
h AS (SELECT *, n - row_number() OVER (PARTITION BY site, variable, rule ORDER BY n) AS grp FROM n WHERE score > threshold)
SELECT site, variable, rule, max(c) AS longest FROM (SELECT site, variable, rule, grp, count(*) AS c FROM h GROUP BY ALL) GROUP BY ALL""")
def d19(spark, sf):
    placed = numbered(scores(spark, sf), [*KEYS, "rule"], "step", "n")
    return rules.longest_run(placed.where("score > threshold"), [*KEYS, "rule"], "n")


RULED = f"""{FC}, {RAINM}, real AS (SELECT site, variable, step, value, abs(value - pred) AS err FROM fc WHERE value IS NOT NULL AND pred IS NOT NULL),
cal AS (SELECT site, variable, quantile_cont(err, 0.5) AS em, greatest(quantile_cont(err, 0.75) - quantile_cont(err, 0.25), 1e-6) AS ei,
  quantile_cont(value, 0.5) AS vm, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS vi FROM real GROUP BY site, variable HAVING site <> 'error' OR variable <> 'depth'),
rs AS (SELECT r.site, r.variable, r.step, (err - em) / ei AS s1, 2.5 * coalesce(deployed_mode, 1.0) AS t1, abs((value - vm) / vi) AS s2, 2.5 AS t2
  FROM real r JOIN cal USING (site, variable) LEFT JOIN mult ON mult.step = r.step)"""


def ruled(spark, sf):
    def make():
        real = forecasts(spark, sf).where("value IS NOT NULL AND pred IS NOT NULL").withColumn(
            "err", F.abs(F.col("value") - F.col("pred"))
        )
        cal = rules.robust_calibration(real, KEYS, "err", "value").where("site <> 'error' OR variable <> 'depth'")
        return rules.two_rules(real, cal, base.wet(spark, sf), KEYS, 2.5, 2.5)

    return stored(spark, ("ruled", sf), make)


@query("j13_forecast_residual_rule", f"""
WITH {RULED} SELECT site, variable, step, r6(s1) AS score, r6(t1) AS threshold, s1 > t1 AS over_line FROM rs""")
def j13(spark, sf):
    return ruled(spark, sf).select(*AT, r6("s1").alias("score"), r6("t1").alias("threshold"), (F.col("s1") > F.col("t1")).alias("over_line"))


@query("j14_level_shift_rule", f"""
WITH {RULED} SELECT site, variable, r6(max(s2)) AS peak, count_if(s2 > t2) AS n_over, count_if(s2 > t2) >= 3 AS flagged FROM rs GROUP BY ALL""")
def j14(spark, sf):
    over = F.count_if(F.col("s2") > F.col("t2"))
    return ruled(spark, sf).groupBy(*KEYS).agg(r6(F.max("s2")).alias("peak"), over.alias("n_over"), (over >= 3).alias("flagged"))


@query("j15_judgement", f"""
WITH {RULED}, n AS (SELECT site, variable, count(*) AS n_real, count_if(s1 > t1) AS o1, count_if(s2 > t2) AS o2 FROM rs GROUP BY ALL)
SELECT site, variable, n_real, n_real >= 250 AS judged, CASE WHEN n_real < 250 THEN 'insufficient_real_data'
  WHEN o1 >= 3 AND o2 >= 3 THEN 'forecast_residual,level_shift' WHEN o1 >= 3 THEN 'forecast_residual'
  WHEN o2 >= 3 THEN 'level_shift' ELSE '' END AS rules_fired FROM n""")
def j15(spark, sf):
    return rules.judge(ruled(spark, sf), KEYS, min_real=250, min_over=3)


@query("j20_support_stack", f"""
WITH {NULLS}, p AS (SELECT site, variable, step, max(CASE WHEN channel = 'loo_channel' THEN p END) AS p1,
   max(CASE WHEN channel = 'dispersion' THEN p END) AS p2 FROM pv GROUP BY ALL),
b AS (SELECT c.site, c.variable, c.step, c.excursion AS score, coalesce(m.step_mode, 1.0)::DOUBLE AS m1, coalesce(m.decay_mode, 1.0) AS m2,
   coalesce(p1 < 0.02, false) AS d1, coalesce(p2 < 0.02, false) AS d2 FROM ch c LEFT JOIN mult m ON m.step = c.step LEFT JOIN p ON p.site = c.site AND p.variable = c.variable AND p.step = c.step),
f AS (SELECT *, 1.5 * m1 * m2 AS line, coalesce(score > 1.5 * m1 * m2, false) AS fired FROM b)
SELECT site, variable, step, r6(line) AS final_threshold, fired AS primary_fired,
  CASE WHEN fired OR d1 OR d2 THEN 'fired' WHEN score IS NULL THEN 'not_scorable' ELSE 'clear' END AS verdict,
  CASE WHEN coalesce(score > 1.5 * m2, false) OR d1 OR d2 THEN 'fired' WHEN score IS NULL THEN 'not_scorable' ELSE 'clear' END AS without_step_gate,
  CASE WHEN fired OR d2 THEN 'fired' WHEN score IS NULL THEN 'not_scorable' ELSE 'clear' END AS without_loo FROM f""")
def j20(spark, sf):
    p = pvals(spark, sf).groupBy(*AT).pivot("channel", ["loo_channel", "dispersion"]).agg(F.first("p"))
    gates = base.wet(spark, sf).select("step", "step_mode", "decay_mode")
    rows = channels(spark, sf).select(*AT, F.col("excursion").alias("score")).join(gates, "step", "left").join(p, AT, "left")
    out = rules.support_stack(
        rows, F.lit(1.5), {"step_gate": F.col("step_mode"), "decay_gate": F.col("decay_mode")},
        {"loo": F.col("loo_channel") < 0.02, "dispersion": F.col("dispersion") < 0.02},
    )
    return out.select(
        *AT, r6("final_threshold").alias("final_threshold"), "primary_fired", "verdict",
        F.col("without.step_gate").alias("without_step_gate"), F.col("without.loo").alias("without_loo"),
    )


@query("j21_screens_intersect", f"""
WITH {GRID}, {RAINM} SELECT g.site, g.step, bool_and(value IS NOT NULL) AND bool_and(coalesce(decay_mode, 1.0) <= 1.5) AS admitted
FROM g LEFT JOIN mult ON g.step = mult.step GROUP BY g.site, g.step""")
def j21(spark, sf):
    calm = F.coalesce("decay_mode", F.lit(1.0)) <= 1.5
    return series(spark, sf).join(base.wet(spark, sf).select("step", "decay_mode"), "step", "left").groupBy("site", "step").agg(
        (F.bool_and(F.col("value").isNotNull()) & F.bool_and(calm)).alias("admitted")
    )


@query("j22_rethreshold", f"""
WITH {SCORES}, nb AS (SELECT variable, rule, quantile_cont(score, 0.9) AS nb FROM scores GROUP BY ALL)
SELECT site, variable, rule, step, r6(threshold * nb / base) AS threshold, score > threshold * nb / base AS over_line
FROM scores JOIN nb USING (variable, rule)""")
def j22(spark, sf):
    lines = quantiles(scores(spark, sf), ["variable", "rule"], "score", {"new": 0.9})
    moved = F.col("threshold") * F.col("new") / F.col("base")
    return scores(spark, sf).join(lines, ["variable", "rule"]).select(
        *AT, "rule", r6(moved).alias("threshold"), (F.col("score") > moved).alias("over_line")
    )


I7SQL = f"""{FC}, y AS (SELECT site, variable, step, value AS y, pred AS m, scale AS s, (value - pred) / scale AS z FROM fc WHERE value IS NOT NULL AND pred IS NOT NULL),
er AS (SELECT *, least(abs(z) / sqrt(2.0), 6.0) AS a FROM y),
e2 AS (SELECT *, sign(z) * least(1.0, 2 / sqrt(pi()) * exp(-a * a) * (a + coalesce((SELECT sum(CASE WHEN a > 0 THEN
   exp(i * ln(2.0) + (2 * i + 1) * ln(a) - (lgamma(2 * i + 2) - i * ln(2.0) - lgamma(i + 1))) ELSE 0 END)
   FROM range(1, 121) t(i)), 0))) AS erf FROM er),
sc2 AS (SELECT *, 0.5 * z * z + ln(s) + 0.5 * ln(2 * pi()) AS nll,
   s * (z * erf + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps, abs(z) <= 1.6448536269514722 AS in90 FROM e2)"""


@query("i7_gaussian_scores", f"WITH {I7SQL} SELECT site, variable, step, r6(nll) AS nll, r6(crps) AS crps, in90 FROM sc2")
def i7(spark, sf):
    return probabilistic(spark, sf).select(*AT, r6("nll").alias("nll"), r6("crps").alias("crps"), "in90")


def probabilistic(spark, sf):
    y, m, s = F.col("value"), F.col("pred"), F.col("scale")
    return forecasts(spark, sf).where("value IS NOT NULL AND pred IS NOT NULL").withColumns({
        "nll": stats.gaussian_nll(y, m, s), "crps": stats.gaussian_crps(y, m, s),
        "in90": F.abs((y - m) / s) <= 1.6448536269514722,
    })


@query("m9_probabilistic_forecast_table", f"""
WITH {I7SQL} SELECT coalesce(site, 'all') AS site, coalesce(variable, 'all') AS variable, count(*) AS n, r6(avg(nll)) AS nll,
  r6(avg(crps)) AS crps, r6(avg(abs(y - m))) AS mae, r6(avg(in90::INT)) AS cov90 FROM sc2 GROUP BY GROUPING SETS ((site, variable), ())""")
def m9(spark, sf):
    out = probabilistic(spark, sf).groupingSets([["site", "variable"], []], "site", "variable").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("nll")).alias("nll"), r6(F.avg("crps")).alias("crps"),
        r6(F.avg(F.abs(F.col("value") - F.col("pred")))).alias("mae"), r6(F.avg(F.col("in90").cast("int"))).alias("cov90"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in KEYS})
