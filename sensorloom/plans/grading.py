"""Event scoring, skill and comparison studies."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sensorloom.operators import evaluate, frames, rain as gate, rules, tails
from sensorloom.operators.scale import period_join, quantiles
from sensorloom.plans import base
from sensorloom.plans.base import CHARTS, GRID, HOUR, KEYS, STEP, series
from sensorloom.plans.charts import J2_SQL, SCORES, _baseline, scores
from sensorloom.plans.registry import query, r6
from sensorloom.plans.tails import FC, RULED, STATLONG, forecasts, long_stats, ruled
from sensorloom.session import level as stored

AT = [*KEYS, "step"]
SPANS = ((1, 50, 80), (2, 200, 230), (3, 400, 460))
SP = "sp(span, a, b) AS (VALUES (1, 50, 80), (2, 200, 230), (3, 400, 460)), zero AS (SELECT min(step) AS z0 FROM x), spans AS (SELECT span, a + z0 AS lo, b + z0 AS hi FROM sp, zero)"
MARKED = f"""{J2_SQL}, {SP}, mk AS (SELECT site, step, abs(x) > 2.0 AS over_line,
  EXISTS (SELECT 1 FROM spans WHERE step >= lo AND step <= hi) AS labelled FROM x)"""
RUNS = """{name} AS (SELECT site, n, min(step) AS lo, max(step) AS hi FROM (SELECT site, step, sum(o) OVER (PARTITION BY site ORDER BY step) AS n FROM
  (SELECT site, step, CASE WHEN step - lag(step) OVER (PARTITION BY site ORDER BY step) <= {gap} THEN 0 ELSE 1 END AS o FROM mk WHERE {flag})) GROUP BY ALL)"""
EVENTS = f"""{MARKED}, {RUNS.format(name='er', gap=3, flag='over_line')}, {RUNS.format(name='lr', gap=1, flag='labelled')},
ev2 AS (SELECT mk.*, coalesce(er.n, 0)::BIGINT AS d, coalesce(lr.n, 0)::BIGINT AS l FROM mk LEFT JOIN er ON er.site = mk.site AND mk.step BETWEEN er.lo AND er.hi
  LEFT JOIN lr ON lr.site = mk.site AND mk.step BETWEEN lr.lo AND lr.hi)"""
CLASSED = f"""{EVENTS}, lg AS (SELECT *, lag(l) OVER w AS pl, lag(d) OVER w AS pd FROM ev2 WINDOW w AS (PARTITION BY site ORDER BY step)),
gr AS (SELECT *, sum(CASE WHEN pl IS NOT NULL AND (l <> pl OR d <> pd) AND ((pl = 0 AND pd = 0) OR (l = 0 AND d = 0) OR (l <> pl AND d <> pd)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY site ORDER BY step) AS grp FROM lg),
cls AS (SELECT site, step, grp, CASE WHEN max(l) OVER g > 0 AND max(d) OVER g > 0 THEN 'tp' WHEN max(d) OVER g > 0 THEN 'fp' WHEN max(l) OVER g > 0 THEN 'fn' ELSE 'tn' END AS class
  FROM gr WINDOW g AS (PARTITION BY site, grp))"""
CARD = f"""{CLASSED}, st AS (SELECT *, lag(class) OVER (PARTITION BY site ORDER BY step) AS was FROM cls),
mt AS (SELECT site, count_if(class = 'tp') AS tp, count_if(class = 'fp') AS fp, count_if(class = 'fn') AS fn FROM st WHERE was IS NULL OR was <> class GROUP BY site),
wk AS (SELECT site, count_if(NOT labelled) * {HOUR / 604800.0!r}::DOUBLE AS weeks FROM mk GROUP BY site),
fa AS (SELECT site, count(*) AS alarms FROM (SELECT site, step - lag(step) OVER (PARTITION BY site ORDER BY step) AS gap FROM mk WHERE over_line AND NOT labelled) WHERE gap IS NULL OR gap > 3 GROUP BY site),
rp AS (SELECT site, avg(s) AS rp FROM (SELECT site, grp, avg(labelled::INT) AS s FROM (SELECT *, step - row_number() OVER (PARTITION BY site ORDER BY step) AS grp FROM mk WHERE over_line) GROUP BY ALL) GROUP BY site),
rr AS (SELECT site, avg(s) AS rr FROM (SELECT site, grp, avg(over_line::INT) AS s FROM (SELECT *, step - row_number() OVER (PARTITION BY site ORDER BY step) AS grp FROM mk WHERE labelled) GROUP BY ALL) GROUP BY site)"""


def spans(spark, sf):
    zero = _baseline(spark, sf).agg(F.min("step").alias("z"))
    return spark.createDataFrame(list(SPANS), "span int, a bigint, b bigint").crossJoin(zero).select(
        "span", (F.col("a") + F.col("z")).alias("lo"), (F.col("b") + F.col("z")).alias("hi")
    )


def marked(spark, sf):
    def make():
        rows = _baseline(spark, sf)
        hit = period_join(rows.select("step").distinct(), spans(spark, sf), [], "step", "lo", "hi", 2048)
        labels = hit.select("step").distinct().withColumn("_l", F.lit(True))
        return rows.join(labels, "step", "left").select(
            "site", "step", (F.abs("x") > 2.0).alias("over_line"), F.col("_l").isNotNull().alias("labelled")
        )

    return stored(spark, ("marked", sf), make)


def numbered_events(spark, sf):
    out = evaluate.number_events(marked(spark, sf), ["site"], "over_line", 2, "d")
    return stored(spark, ("events", sf), lambda: evaluate.number_events(out, ["site"], "labelled", 0, "l"))


def classed(spark, sf):
    return stored(
        spark, ("classed", sf), lambda: evaluate.classify_events(numbered_events(spark, sf), ["site"], "l", "d")
    )


@query("m1_event_numbers", f"WITH {EVENTS} SELECT site, step, d AS detected_event, l AS labelled_event FROM ev2")
def m1(spark, sf):
    return numbered_events(spark, sf).select("site", "step", F.col("d").alias("detected_event"), F.col("l").alias("labelled_event"))


@query("m2_event_classes", f"WITH {CLASSED} SELECT site, step, class FROM cls")
def m2(spark, sf):
    return classed(spark, sf).select("site", "step", "class")


@query("m3_event_metrics", f"""
WITH {CARD} SELECT site, tp, fp, fn, r6(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) AS precision, r6(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END) AS recall FROM mt""")
def m3(spark, sf):
    return evaluate.event_metrics(classed(spark, sf), ["site"]).withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query("m4_caught_spans", f"""
WITH {MARKED}, f AS (SELECT site, span, min(step) AS f FROM mk JOIN spans ON step BETWEEN lo AND hi WHERE over_line GROUP BY ALL)
SELECT s.site, spans.span, f IS NOT NULL AS caught, (f - lo) * 60.0::DOUBLE AS minutes FROM (SELECT DISTINCT site FROM mk) s CROSS JOIN spans LEFT JOIN f ON f.site = s.site AND f.span = spans.span""")
def m4(spark, sf):
    return evaluate.caught(marked(spark, sf), spans(spark, sf), ["site"], "over_line", HOUR)


@query("m5_false_alarms_per_week", f"""
WITH {CARD} SELECT site, coalesce(alarms, 0) AS alarms, r6(coalesce(alarms, 0) / weeks) AS per_week FROM wk LEFT JOIN fa USING (site)""")
def m5(spark, sf):
    rows = marked(spark, sf).withColumn("clean", ~F.col("labelled"))
    return evaluate.false_alarms_per_week(rows, ["site"], "over_line", "clean", HOUR, 2).withColumn("per_week", r6("per_week"))


@query("m6_range_scores", f"WITH {CARD} SELECT site, r6(rp) AS range_precision, r6(rr) AS range_recall FROM rp FULL JOIN rr USING (site)")
def m6(spark, sf):
    out = evaluate.range_scores(marked(spark, sf), ["site"], "labelled", "over_line")
    return out.withColumns({c: r6(c) for c in ("range_precision", "range_recall")})


@query("m7_score_card", f"""
WITH {CARD} SELECT site, tp, fp, fn, r6(coalesce(alarms, 0) / weeks) AS per_week, r6(rp) AS range_precision, r6(rr) AS range_recall
FROM mt JOIN wk USING (site) LEFT JOIN fa USING (site) LEFT JOIN rp USING (site) LEFT JOIN rr USING (site)""")
def m7(spark, sf):
    rows = marked(spark, sf).withColumn("clean", ~F.col("labelled"))
    metrics = evaluate.event_metrics(classed(spark, sf), ["site"]).select("site", "tp", "fp", "fn")
    weekly = evaluate.false_alarms_per_week(rows, ["site"], "over_line", "clean", HOUR, 2).select("site", r6("per_week").alias("per_week"))
    ranges = evaluate.range_scores(rows, ["site"], "labelled", "over_line").select(
        "site", r6("range_precision").alias("range_precision"), r6("range_recall").alias("range_recall")
    )
    return metrics.join(weekly, "site").join(ranges, "site", "left")


@query("m8_forecast_skill", f"""
WITH {FC}, rg AS (SELECT site, variable, regr_slope(value, p1) AS a, regr_intercept(value, p1) AS b FROM (SELECT *, lag(value) OVER (PARTITION BY site, variable ORDER BY step) AS p1 FROM fc) WHERE step * {STEP} // 86400 % 2 = 0 GROUP BY ALL),
m AS (SELECT *, a * pred + b AS model FROM fc JOIN rg USING (site, variable)),
k AS (SELECT site, variable, count(*) AS n, avg(abs(value - model)) AS mae, avg((value - model) * (value - model)) AS mm, avg((value - pred) * (value - pred)) AS mp, avg((value - diurnal) * (value - diurnal)) AS md
  FROM m WHERE step * {STEP} // 86400 % 2 = 1 AND value IS NOT NULL AND model IS NOT NULL AND pred IS NOT NULL AND diurnal IS NOT NULL GROUP BY ALL)
SELECT site, variable, n, r6(mae) AS mae_model, r6(sqrt(mm)) AS rmse_model, r6(1 - mm / mp) AS skill_persistence, r6(1 - mm / md) AS skill_diurnal,
  CASE WHEN n < 200 THEN 'insufficient data' WHEN mm < mp AND mm < md THEN 'beats both baselines' WHEN mm < mp THEN 'beats only persistence'
  WHEN mm < md THEN 'beats only diurnal naive' ELSE 'beats neither baseline' END AS verdict FROM k""")
def m8(spark, sf):
    out = skill(spark, sf)
    return out.withColumns({c: r6(c) for c in ("mae_model", "rmse_model", "skill_persistence", "skill_diurnal")})


def skill(spark, sf):
    from sensorloom.operators.forecast import autoregression

    odd_day = F.floor(F.col("step") * STEP / 86400) % 2 == 1
    fit = autoregression(series(spark, sf), KEYS, ~odd_day).select(*KEYS, "slope", "intercept").distinct()
    rows = forecasts(spark, sf).where(odd_day).join(fit, list(KEYS)).select(
        *AT, "value", F.col("pred").alias("persistence"), "diurnal", (F.col("slope") * F.col("pred") + F.col("intercept")).alias("model")
    )
    return evaluate.forecast_skill(rows, KEYS, "model")


@query("m10_share_quartiles", f"""
WITH {FC}, s AS (SELECT site, abs(value - loo) / (abs(value - loo) + abs(value - pred)) AS s FROM fc WHERE abs(value - loo) + abs(value - pred) > 0)
SELECT site, r6(quantile_cont(s, 0.25)) AS q25, r6(quantile_cont(s, 0.5)) AS q50, r6(quantile_cont(s, 0.75)) AS q75, count(*) AS n FROM s GROUP BY site""")
def m10(spark, sf):
    a, b = F.abs(F.col("value") - F.col("loo")), F.abs(F.col("value") - F.col("pred"))
    shares = forecasts(spark, sf).where(a + b > 0).select("site", (a / (a + b)).alias("s"))
    out = quantiles(shares, ["site"], "s", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, count="n")
    return out.withColumns({c: r6(c) for c in ("q25", "q50", "q75")})


CLEANFP = f"""{RULED}, wn AS (SELECT site, variable, step // 12 AS win, count(*) AS steps, count_if(s1 > t1) >= 3 AS flagged, max(t1) > 2.5 AS rainy FROM rs GROUP BY ALL HAVING count(*) >= 6)"""


@query("m11_clean_window_false_positives", f"""
WITH {CLEANFP} SELECT site, variable, rainy, count(*) AS windows, count_if(flagged) AS flagged, r6(avg(flagged::INT)) AS rate FROM wn GROUP BY ALL""")
def m11(spark, sf):
    return clean_windows(spark, sf).groupBy(*KEYS, "rainy").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("flagged").alias("flagged"), r6(F.avg(F.col("flagged").cast("int"))).alias("rate")
    )


def clean_windows(spark, sf):
    return ruled(spark, sf).groupBy(*KEYS, F.floor(F.col("step") / 12).alias("win")).agg(
        F.count(F.lit(1)).alias("steps"), (F.count_if(F.col("s1") > F.col("t1")) >= 3).alias("flagged"), (F.max("t1") > 2.5).alias("rainy")
    ).where("steps >= 6")


INJECT = f"""{GRID}, cal2 AS (SELECT site, variable, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS i FROM g GROUP BY ALL),
wd AS (SELECT g.*, step % 12 AS i, step // 12 AS win FROM g WHERE value IS NOT NULL), mg(magnitude) AS (VALUES (25.0), (100.0), (400.0)), sh(shape) AS (VALUES ('step'), ('ramp'), ('spike')),
inj AS (SELECT wd.site, wd.variable, win, shape, magnitude::DOUBLE AS magnitude, count_if(abs(value + magnitude * CASE shape WHEN 'step' THEN 1 WHEN 'ramp' THEN wd.i / 11.0 ELSE CASE WHEN wd.i = 6 THEN 1 ELSE 0 END END - m) / c.i > 2.5) AS n_over
  FROM wd JOIN cal2 c USING (site, variable), mg, sh GROUP BY ALL)"""


@query("m12_injection_study", f"""
WITH {INJECT} SELECT shape, magnitude, count(*) AS cases, r6(avg((n_over >= 3)::INT)) AS detected FROM inj GROUP BY ALL""")
def m12(spark, sf):
    return injected(spark, sf).groupBy("shape", "magnitude").agg(
        F.count(F.lit(1)).alias("cases"), r6(F.avg((F.col("n_over") >= 3).cast("int"))).alias("detected")
    )


def calibration(spark, sf):
    def make():
        q = quantiles(series(spark, sf), KEYS, "value", {"a": 0.25, "m": 0.5, "b": 0.75})
        return q.select(*KEYS, F.col("m").alias("centre"), F.greatest(F.col("b") - F.col("a"), F.lit(1e-6)).alias("spread"))

    return stored(spark, ("calibration", sf), make)


def windows(spark, sf):
    real = series(spark, sf).where("value IS NOT NULL").join(calibration(spark, sf), list(KEYS))
    return real.withColumns({"i": F.col("step") % 12, "win": F.floor(F.col("step") / 12)})


def injected(spark, sf):
    cases = evaluate.inject(windows(spark, sf), (25, 100, 400), 12)
    return cases.groupBy(*KEYS, "win", "shape", "magnitude").agg(
        F.count_if(F.abs(F.col("value") - F.col("centre")) / F.col("spread") > 2.5).alias("n_over")
    )


@query("m12_smallest_reliable_magnitude", f"""
WITH {INJECT}, r AS (SELECT site, variable, shape, magnitude, avg((n_over >= 3)::INT) AS d FROM inj GROUP BY ALL)
SELECT site, variable, shape, min(CASE WHEN d >= 0.5 THEN magnitude END) AS smallest FROM r GROUP BY ALL""")
def m12_smallest(spark, sf):
    rate = injected(spark, sf).groupBy(*KEYS, "shape", "magnitude").agg(F.avg((F.col("n_over") >= 3).cast("int")).alias("d"))
    return rate.groupBy(*KEYS, "shape").agg(F.min(F.when(F.col("d") >= 0.5, F.col("magnitude"))).alias("smallest"))


FAULTS = f"""{INJECT}, hd AS (SELECT site, variable, win, arg_min(value, step) AS head, max(abs(value - m) / c.i) AS plain FROM wd JOIN cal2 c USING (site, variable) GROUP BY ALL),
fs AS (SELECT wd.*, c.m, c.i AS sp, head FROM wd JOIN cal2 c USING (site, variable) JOIN hd USING (site, variable, win)),
sw AS (SELECT site, variable, win, shape, max(abs(CASE shape WHEN 'stuck' THEN head WHEN 'stale' THEN CASE WHEN i < 6 THEN value END WHEN 'partial' THEN value + (m - value) * 0.5
   WHEN 'drift' THEN value + sp * 4 * (i / 11.0) WHEN 'spike' THEN CASE WHEN i = 10 THEN value + sp * 6 ELSE value END ELSE 2 * m - value END - m) / sp) AS score
  FROM fs, (VALUES ('stuck'), ('stale'), ('partial'), ('drift'), ('spike'), ('decouple')) t(shape) GROUP BY ALL),
rk AS (SELECT s.site, s.variable, s.win, s.shape, s.score, 1 + count(CASE WHEN o.plain > s.score THEN 1 END) AS place FROM sw s JOIN hd o ON o.win = s.win AND NOT (o.site = s.site AND o.variable = s.variable)
  WHERE s.score IS NOT NULL GROUP BY ALL)"""


@query("m13_fault_sweep", f"""
WITH {FAULTS} SELECT shape, count(*) AS cases, r6(avg((score > 2.5)::INT)) AS detected, r6(avg((place = 1)::INT)) AS top1, r6(avg(place)) AS mean_rank FROM rk GROUP BY shape""")
def m13(spark, sf):
    return ranked_faults(spark, sf).groupBy("shape").agg(
        F.count(F.lit(1)).alias("cases"), r6(F.avg((F.col("score") > 2.5).cast("int"))).alias("detected"),
        r6(F.avg((F.col("place") == 1).cast("int"))).alias("top1"), r6(F.avg("place")).alias("mean_rank"),
    )


def ranked_faults(spark, sf):
    """Each faulted node against the untouched scores of its window's other nodes (one network's worth)."""
    z = F.abs(F.col("value") - F.col("centre")) / F.col("spread")
    rows = windows(spark, sf)
    heads = rows.groupBy(*KEYS, "win").agg(F.min_by("value", "step").alias("head"), F.max(z).alias("plain"))
    cases = evaluate.fault_shapes(rows.join(heads.select(*KEYS, "win", "head"), [*KEYS, "win"]), 12, {"partial": 0.5, "drift": 4.0, "spike": 6.0})
    swept = cases.groupBy(*KEYS, "win", "shape").agg(F.max(F.abs(F.col("faulted") - F.col("centre")) / F.col("spread")).alias("score")).where("score IS NOT NULL")
    others = heads.groupBy("win").agg(F.collect_list(F.struct(*KEYS, "plain")).alias("net"))
    better = F.size(F.filter("net", lambda o: (o["plain"] > F.col("score")) & ~((o["site"] == F.col("site")) & (o["variable"] == F.col("variable")))))
    return swept.join(others, "win").where(F.size("net") > 1).select(*KEYS, "win", "shape", "score", (better + 1).alias("place"))


@query("g3_rank_of_truth", f"WITH {FAULTS} SELECT win, shape, min(place) AS best_place FROM rk GROUP BY ALL")
def g3(spark, sf):
    return ranked_faults(spark, sf).groupBy("win", "shape").agg(F.min("place").cast("bigint").alias("best_place"))


@query("g5_calmest_decile", f"""
WITH {GRID}, s AS (SELECT site, variable, step // 12 AS win, stddev_pop(value) AS sd FROM g GROUP BY ALL), a AS (SELECT win, quantile_cont(sd, 0.5) AS activity FROM s GROUP BY win),
n AS (SELECT count(*) AS n FROM a) SELECT win, r6(activity) AS activity FROM a, n QUALIFY row_number() OVER (ORDER BY activity, win) <= greatest(1, n // 10)""")
def g5(spark, sf):
    per = series(spark, sf).groupBy(*KEYS, F.floor(F.col("step") / 12).alias("win")).agg(F.stddev_pop("value").alias("sd"))
    activity = per.groupBy("win").agg(F.percentile("sd", 0.5).alias("activity"))
    # The cut is an order statistic: rank windows in chunks of activity, not in one sorted task.
    from sensorloom.operators.scale import numbered

    placed = numbered(activity.where("activity IS NOT NULL"), [], "activity", "n", 5, ("win",))
    sizes = activity.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("keep"))
    return placed.crossJoin(F.broadcast(sizes)).where("n < keep").select("win", r6("activity").alias("activity"))


@query("m14_deployability_verdict", f"""
WITH {CLEANFP}, fp AS (SELECT site, variable, avg(flagged::INT) AS fp FROM wn GROUP BY ALL),
iw AS (SELECT rs.site, rs.variable, step // 12 AS win FROM rs),
g2 AS (SELECT site, variable, quantile_cont(value, 0.5) AS m, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS i FROM g GROUP BY ALL),
dt AS (SELECT site, variable, avg((c >= 3)::INT) AS det FROM (SELECT g.site, g.variable, step // 12 AS win, count_if(abs(value + 100 - m) / i > 2.5) AS c FROM g JOIN g2 USING (site, variable) WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT site, variable, r6(fp) AS false_positive_rate, r6(det) AS detection_rate, CASE WHEN fp <= 0.05 AND det >= 0.5 THEN 'deployable' WHEN det >= 0.5 THEN 'too many false alarms' WHEN fp <= 0.05 THEN 'misses too much' ELSE 'not deployable' END AS verdict
FROM fp JOIN dt USING (site, variable)""")
def m14(spark, sf):
    fp = clean_windows(spark, sf).groupBy(*KEYS).agg(F.avg(F.col("flagged").cast("int")).alias("fp"))
    det = injected(spark, sf).where("shape = 'step' AND magnitude = 100").groupBy(*KEYS).agg(F.avg((F.col("n_over") >= 3).cast("int")).alias("det"))
    quiet, sharp = F.col("fp") <= 0.05, F.col("det") >= 0.5
    verdict = F.when(quiet & sharp, "deployable").when(sharp, "too many false alarms").when(quiet, "misses too much").otherwise("not deployable")
    return fp.join(det, list(KEYS)).select(*KEYS, r6("fp").alias("false_positive_rate"), r6("det").alias("detection_rate"), verdict.alias("verdict"))


@query("m15_matched_rate_comparison", f"""
WITH {STATLONG}, z AS (SELECT min(step) AS z0 FROM g), sp2(event, a, b) AS (VALUES (1, 100, 140), (2, 220, 260)),
ln AS (SELECT rule, quantile_cont(stat, 0.98) AS line FROM stat, z WHERE NOT EXISTS (SELECT 1 FROM sp2 WHERE step BETWEEN z0 + a AND z0 + b) GROUP BY rule)
SELECT event, rule, r6(line) AS line, count_if(stat > line) AS steps_over, r6(max(stat)) AS peak, arg_max(site || '.' || variable, (round(stat, 9), site, variable)) AS top_node
FROM stat JOIN ln USING (rule) JOIN (SELECT event, z0 + a AS lo, z0 + b AS hi FROM sp2, z) s ON step BETWEEN lo AND hi GROUP BY ALL""")
def m15(spark, sf):
    zero = series(spark, sf).agg(F.min("step").alias("z"))
    events = spark.createDataFrame([(1, 100, 140), (2, 220, 260)], "event int, a bigint, b bigint").crossJoin(zero).select(
        "event", (F.col("a") + F.col("z")).alias("lo"), (F.col("b") + F.col("z")).alias("hi")
    )
    stats = long_stats(spark, sf)
    inside = period_join(stats, events, [], "step", "lo", "hi", 512)
    outside = stats.join(inside.select("step").distinct(), "step", "left_anti")
    lines = quantiles(outside, ["rule"], "stat", {"line": 0.98})
    top = F.max_by(F.concat_ws(".", *KEYS), F.struct(F.round("stat", 9), *KEYS))
    return inside.join(lines, "rule").groupBy("event", "rule", r6("line").alias("line")).agg(
        F.count_if(F.col("stat") > F.col("line")).alias("steps_over"), r6(F.max("stat")).alias("peak"), top.alias("top_node")
    )


@query("m16_k_sweep", f"""
WITH {GRID}, w AS (SELECT *, list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY site, variable ORDER BY step ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS seen FROM g),
m AS (SELECT *, list_median(seen) AS m FROM w), s AS (SELECT site, variable, step, abs(value - m) / greatest(list_median(list_transform(seen, lambda v: abs(v - m))), 1e-9) AS s FROM m WHERE value IS NOT NULL),
k AS (SELECT s.*, k FROM s, (VALUES (2.0), (4.0), (5.2), (8.0), (16.0)) t(k) WHERE s > k),
o AS (SELECT k, CASE WHEN step - lag(step) OVER (PARTITION BY site, variable, k ORDER BY step) <= 8 THEN 0 ELSE 1 END AS o FROM k), wk AS (SELECT count(*) * 7200 / 604800.0 AS weeks FROM g WHERE value IS NOT NULL),
r AS (SELECT k::DOUBLE AS k, sum(o) / any_value(weeks) AS per_week FROM o, wk GROUP BY k)
SELECT k, r6(per_week) AS per_week, k = (SELECT arg_min(k, (abs(per_week - 1.0), k)) FROM r) AS closest FROM r""")
def m16(spark, sf):
    rated = frames.x84(series(spark, sf), KEYS, k=1.0).where("value IS NOT NULL").select(*AT, "x84")
    ks = F.array(*[F.lit(k) for k in (2.0, 4.0, 5.2, 8.0, 16.0)])
    hits = rated.withColumn("k", F.explode(ks)).where("x84 > k")
    alarms = tails.clusters(hits, [*KEYS, "k"], "x84").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    weeks = rated.agg((F.count(F.lit(1)) * (STEP / 604800.0)).alias("weeks"))
    rates = alarms.crossJoin(F.broadcast(weeks)).select("k", (F.col("n") / F.col("weeks")).alias("rate"))
    best = rates.agg(F.min_by("k", F.struct(F.abs(F.col("rate") - 1.0), "k")).alias("best"))
    return rates.crossJoin(F.broadcast(best)).select("k", r6("rate").alias("per_week"), (F.col("k") == F.col("best")).alias("closest"))


DOUBLED = (
    base.RAINM.removeprefix(base.RAIN).replace("rm AS", "rm2 AS").replace("FROM rm)", "FROM rm2)").replace("mult AS", "mult2 AS")
    .replace("coalesce(rain, 0.0)", "2 * coalesce(rain, 0.0)").replace("rain > 0.1", "2 * rain > 0.1")
)


@query("m17_rain_sensitivity", f"""
WITH {RULED}{DOUBLED}, n AS (SELECT 'as measured' AS rain, count_if(s1 > t1) AS fired, count(*) AS judged FROM rs UNION ALL SELECT 'zeroed', count_if(s1 > 2.5), count(*) FROM rs
  UNION ALL SELECT 'doubled', count_if(s1 > 2.5 * coalesce(mult2.deployed_mode, 1.0)), count(*) FROM rs LEFT JOIN mult2 ON mult2.step = rs.step)
SELECT rain, fired, judged FROM n""")
def m17(spark, sf):
    """The residual rule scored again without rain and with twice as much."""
    wetter = gate.wetness(base.rain(spark, sf).withColumn("rain", F.col("rain") * 2), STEP)
    doubled = wetter.select("step", gate.multiplier("deployed", F.col("total"), F.col("dry_hours")).alias("doubled"))
    variants = F.array(
        F.struct(F.lit("as measured").alias("rain"), F.col("t1").alias("line")), F.struct(F.lit("zeroed").alias("rain"), F.lit(2.5).alias("line")),
        F.struct(F.lit("doubled").alias("rain"), (2.5 * F.coalesce("doubled", F.lit(1.0))).alias("line")),
    )
    return ruled(spark, sf).join(doubled, "step", "left").select("s1", F.inline(variants)).groupBy("rain").agg(
        F.count_if(F.col("s1") > F.col("line")).alias("fired"), F.count(F.lit(1)).alias("judged")
    )


PAST = f"""{SCORES}, z AS (SELECT min(step) AS z0 FROM g), pe AS (SELECT id, z0 + a AS lo, z0 + b AS hi, should_alert FROM z,
  (VALUES (1, 20, 40, true), (2, 100, 140, false), (3, 200, 260, true), (4, 900, 950, true)) t(id, a, b, should_alert)),
ct AS (SELECT id, should_alert, c.calibration, count(score) AS judged, count_if(score > threshold * c.scale) AS over FROM pe CROSS JOIN (VALUES ('current', 1.0), ('tighter', 2.0)) c(calibration, scale)
  LEFT JOIN scores ON step BETWEEN lo AND hi GROUP BY ALL)"""


def past(spark, sf):
    zero = series(spark, sf).agg(F.min("step").alias("z"))
    events = spark.createDataFrame(
        [(1, 20, 40, True), (2, 100, 140, False), (3, 200, 260, True), (4, 900, 950, True)], "id int, a bigint, b bigint, should_alert boolean"
    ).crossJoin(zero).select("id", "should_alert", (F.col("a") + F.col("z")).alias("lo"), (F.col("b") + F.col("z")).alias("hi"))
    inside = period_join(scores(spark, sf), events, [], "step", "lo", "hi", 512)
    per = inside.groupBy("id").agg(
        F.count(F.lit(1)).alias("judged"), *[F.count_if(F.col("score") > F.col("threshold") * s).alias(n) for n, s in (("current", 1.0), ("tighter", 2.0))]
    )
    wide = events.select("id", "should_alert").join(per, "id", "left").na.fill(0, ["judged", "current", "tighter"])
    return wide.unpivot(["id", "should_alert", "judged"], ["current", "tighter"], "calibration", "over")


@query("m18_past_event_verdicts", f"""
WITH {PAST} SELECT id, calibration, CASE WHEN judged = 0 THEN 'not enough' WHEN should_alert THEN CASE WHEN over > 0 THEN 'caught' ELSE 'missed' END
  ELSE CASE WHEN over > 0 THEN 'alerted' ELSE 'stayed quiet' END END AS verdict FROM ct""")
def m18(spark, sf):
    hit = F.col("over") > 0
    verdict = F.when(F.col("judged") == 0, "not enough").when(
        F.col("should_alert"), F.when(hit, "caught").otherwise("missed")
    ).otherwise(F.when(hit, "alerted").otherwise("stayed quiet"))
    return past(spark, sf).select("id", "calibration", verdict.alias("verdict"))


@query("m19_before_and_after", f"""
WITH {SCORES} SELECT rule, count_if(score > threshold) AS before, count_if(score > threshold * 2.0) AS after FROM scores GROUP BY rule""")
def m19(spark, sf):
    return scores(spark, sf).groupBy("rule").agg(
        F.count_if(F.col("score") > F.col("threshold")).alias("before"), F.count_if(F.col("score") > F.col("threshold") * 2.0).alias("after")
    )


@query("c9_event_score_join", f"""
WITH {PAST}, ex AS (SELECT id, rule, count(*) AS n, r6(max(score)) AS peak FROM pe JOIN scores ON step BETWEEN lo AND hi GROUP BY ALL)
SELECT id, max(CASE WHEN rule = 'cusum_shift' THEN peak END) AS cusum_peak, max(CASE WHEN rule = 'ewma_drift' THEN peak END) AS ewma_peak, sum(n)::BIGINT AS n FROM ex GROUP BY id""")
def c9(spark, sf):
    zero = series(spark, sf).agg(F.min("step").alias("z"))
    events = spark.createDataFrame([(1, 20, 40), (2, 100, 140), (3, 200, 260), (4, 900, 950)], "id int, a bigint, b bigint").crossJoin(zero).select(
        "id", (F.col("a") + F.col("z")).alias("lo"), (F.col("b") + F.col("z")).alias("hi")
    )
    inside = period_join(scores(spark, sf), events, [], "step", "lo", "hi", 512)

    def peak(rule):
        return r6(F.max(F.when(F.col("rule") == rule, F.col("score"))))

    return inside.groupBy("id").agg(
        peak("cusum_shift").alias("cusum_peak"), peak("ewma_drift").alias("ewma_peak"), F.count(F.lit(1)).alias("n")
    )
