"""Forecasts from several inputs: next step (P4), leave-one-out from siblings and upstream (P5), their skill (M8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sensorloom.functions import clock
from sensorloom.operators import evaluate, forecast, graph
from sensorloom.operators.scale import framed
from sensorloom.plans import base
from sensorloom.plans.base import KEYS, RAIN, STEP
from sensorloom.plans.flow import PATHS, network
from sensorloom.plans.registry import query, r6
from sensorloom.plans.tails import AT, FC, forecasts
from sensorloom.session import level as stored

NEXT = ("pred", "day_gap", "near_gap", "rained", "hour_sin", "hour_cos")
OTHERS = ("loo", "upstream_gap")
FIT_DAY = f"step * {STEP} // 86400 % 2 = 0"


def by_orthogonal_inputs(source: str, target: str, inputs: tuple[str, ...]) -> str:
    """CTEs ending in ``fitted`` with column ``made``: each input is cleared of the ones before it, then regressed on alone.

    A fit per (site, variable) on the rows of ``fit``, without normal equations.
    """
    key, known = "PARTITION BY site, variable", " AND ".join(f"{c} IS NOT NULL" for c in (target, *inputs))
    parts = [f"q0 AS (SELECT *, fit AND {known} AS ok FROM {source})"]

    def mean(x: str) -> str:
        return f"avg({x}) FILTER (ok) OVER ({key})"

    def slope(x: str, i: int) -> str:
        square = f"sum(u{i} * u{i}) FILTER (ok) OVER ({key})"
        return f"CASE WHEN {square} > 1e-9 * s{i} THEN sum(({x}) * u{i}) FILTER (ok) OVER ({key}) / ({square}) ELSE 0 END"

    for j, name in enumerate(inputs):
        parts.append(f"c{j} AS (SELECT *, {name} - {mean(name)} AS o{j} FROM q{j})")
        cleared = " ".join(f"- ({slope(f'o{j}', i)}) * u{i}" for i in range(j))
        parts.append(f"q{j + 1} AS (SELECT *, o{j} {cleared} AS u{j}, sum(o{j} * o{j}) FILTER (ok) OVER ({key}) AS s{j} FROM c{j})")
    made = " ".join(f"+ ({slope(target, i)}) * u{i}" for i in range(len(inputs)))
    parts.append(f"fitted AS (SELECT *, {mean(target)} {made} AS made FROM q{len(inputs)})")
    return ", ".join(parts)


NEXT_ROWS = f"""{FC}, {RAIN.removeprefix('WITH ')}, nb AS (SELECT *, lag(loo) OVER (PARTITION BY site, variable ORDER BY step) AS near FROM fc),
x AS (SELECT nb.*, nb.value - pred AS change, coalesce(diurnal - pred, 0 * pred) AS day_gap, coalesce(near - pred, 0 * pred) AS near_gap, coalesce(rain, 0) AS rained,
  sin({2 * math.pi} * (step * {STEP} % 86400) / 86400.0) AS hour_sin, cos({2 * math.pi} * (step * {STEP} % 86400) / 86400.0) AS hour_cos, {FIT_DAY} AS fit
  FROM nb LEFT JOIN (SELECT step + 1 AS step, rain FROM rain) USING (step))"""
NEXT_SQL = f"{NEXT_ROWS}, {by_orthogonal_inputs('x', 'change', NEXT)}"


def next_steps(spark, sf):
    """The change from the last real value, on that value, the day before, the siblings before, rain and the clock."""
    def make():
        rows = framed(forecasts(spark, sf), KEYS, "step", {"near": lambda w: F.lag("loo").over(w)}, before=1)
        rain = base.rain(spark, sf).select((F.col("step") + 1).alias("step"), F.coalesce("rain", F.lit(0.0)).alias("rained"))
        hours = clock.clock_features(F.timestamp_seconds(F.col("step") * STEP))
        rows = rows.join(rain, "step", "left").withColumns({
            "change": F.col("value") - F.col("pred"),
            "day_gap": F.when(F.col("pred").isNotNull(), F.coalesce(F.col("diurnal") - F.col("pred"), F.lit(0.0))),
            "near_gap": F.when(F.col("pred").isNotNull(), F.coalesce(F.col("near") - F.col("pred"), F.lit(0.0))),
            "rained": F.coalesce("rained", F.lit(0.0)),
            "hour_sin": hours["hour_sin"], "hour_cos": hours["hour_cos"],
        })
        fit = forecast.linear_fit(rows, KEYS, "change", NEXT, _fit_day())
        return forecast.linear_forecast(rows, fit, KEYS, NEXT, "_change").withColumn("model", F.col("pred") + F.col("_change"))

    return stored(spark, ("next_steps", sf), make)


def _fit_day():
    return F.floor(F.col("step") * STEP / 86400) % 2 == 0


@query("p4_linear_forecast", f"WITH {NEXT_SQL} SELECT site, variable, step, r6(pred + made) AS model FROM fitted")
def p4_linear(spark, sf):
    return next_steps(spark, sf).select(*AT, r6("model").alias("model"))


def skill_sql(rows: str, model: str) -> str:
    return f"""
WITH {rows}, m AS (SELECT *, {model} AS model FROM fitted),
k AS (SELECT site, variable, count(*) AS n, avg(abs(value - model)) AS mae, avg((value - model) * (value - model)) AS mm, avg((value - pred) * (value - pred)) AS mp, avg((value - diurnal) * (value - diurnal)) AS md
  FROM m WHERE NOT fit AND value IS NOT NULL AND model IS NOT NULL AND pred IS NOT NULL AND diurnal IS NOT NULL GROUP BY ALL)
SELECT site, variable, n, r6(mae) AS mae_model, r6(sqrt(mm)) AS rmse_model, r6(1 - mm / mp) AS skill_persistence, r6(1 - mm / md) AS skill_diurnal,
  CASE WHEN n < 200 THEN 'insufficient data' WHEN mm < mp AND mm < md THEN 'beats both baselines' WHEN mm < mp THEN 'beats only persistence'
  WHEN mm < md THEN 'beats only diurnal naive' ELSE 'beats neither baseline' END AS verdict FROM k"""


def _skill(rows):
    out = evaluate.forecast_skill(
        rows.where(~_fit_day()).select(*AT, "value", F.col("pred").alias("persistence"), "diurnal", "model"), KEYS, "model"
    )
    return out.withColumns({c: r6(c) for c in ("mae_model", "rmse_model", "skill_persistence", "skill_diurnal")})


@query("m8_linear_forecast_skill", skill_sql(NEXT_SQL, "pred + made"))
def m8_linear(spark, sf):
    """Fitted on even days, graded on odd ones."""
    return _skill(next_steps(spark, sf))


OTHER_SQL = f"""{FC}, {PATHS}, up AS (SELECT dst AS site, variable, step, avg(value) AS upstream FROM fc JOIN paths ON src = site WHERE value IS NOT NULL GROUP BY ALL),
x AS (SELECT fc.*, coalesce(upstream - loo, 0 * loo) AS upstream_gap, {FIT_DAY} AS fit FROM fc LEFT JOIN up USING (site, variable, step)), {by_orthogonal_inputs('x', 'value', OTHERS)}"""


def left_out(spark, sf):
    """Each node from its siblings and from all sites upstream, never from itself."""
    def make():
        paths = graph.closure(network(spark)).select("src", "dst").distinct()
        rows = forecast.upstream_mean(forecasts(spark, sf), paths, "site", ["variable", "step"])
        gap = F.when(F.col("loo").isNotNull(), F.coalesce(F.col("upstream") - F.col("loo"), F.lit(0.0)))
        rows = rows.withColumn("upstream_gap", gap)
        fit = forecast.linear_fit(rows, KEYS, "value", OTHERS, _fit_day())
        return forecast.linear_forecast(rows, fit, KEYS, OTHERS, "model")

    return stored(spark, ("left_out", sf), make)


@query("p5_leave_one_out_regression", f"WITH {OTHER_SQL} SELECT site, variable, step, r6(made) AS model FROM fitted")
def p5_regression(spark, sf):
    return left_out(spark, sf).select(*AT, r6("model").alias("model"))


@query("m8_leave_one_out_skill", skill_sql(OTHER_SQL, "made"))
def m8_left_out(spark, sf):
    return _skill(left_out(spark, sf))
