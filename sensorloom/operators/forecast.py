"""Forecasts from stored series and the channels that score them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.scale import framed, prefix


def persistence(grid: DataFrame, keys: Sequence[str], day_steps: int) -> DataFrame:
    """pred: last real value before the step, with its age; diurnal: the value one day earlier."""
    held = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
    out = prefix(grid, keys, "step", {"_held": ("before", held)})
    out = out.withColumns({
        "pred": F.col("_held.value"), "age": F.col("step") - F.col("_held.step"),
    }).drop("_held")
    return framed(out, keys, "step", {"diurnal": lambda w: F.lag("value", day_steps).over(w)}, before=day_steps)


def autoregression(grid: DataFrame, keys: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """One-lag least squares per key as plain aggregates, and its prediction at every step.

    With ``fit_on`` only those rows are fitted on.
    """
    lagged = framed(grid, keys, "step", {"lag1": lambda w: F.lag("value").over(w)}, before=1)
    known = lagged.where("value IS NOT NULL AND lag1 IS NOT NULL")
    fit = (known if fit_on is None else known.where(fit_on)).groupBy(*keys).agg(
        F.regr_slope("value", "lag1").alias("slope"), F.regr_intercept("value", "lag1").alias("intercept")
    )
    return lagged.join(fit, list(keys)).withColumn("pred", F.col("slope") * F.col("lag1") + F.col("intercept"))


def leave_one_out(grid: DataFrame, group: Sequence[str]) -> DataFrame:
    """Each node's value predicted as the mean of its group's other nodes at the same step."""
    sums = grid.groupBy(*group).agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    own = F.coalesce("value", F.lit(0.0))
    mine = F.col("value").isNotNull().cast("int")
    return grid.join(sums, list(group)).withColumn(
        "loo", F.when(F.col("_n") - mine > 0, (F.col("_sum") - own) / (F.col("_n") - mine))
    ).drop("_sum", "_n")


def _solved(moments: DataFrame, inputs: Sequence[str], tolerance: float) -> DataFrame:
    """Coefficients ``_b_<i>`` from covariances ``_c_<i>_<j>`` and ``_y_<i>``, by a square-root-free Cholesky factorisation.

    Each step is a column over one row per key. An input that the ones before it explain (its remaining share of variance is
    at most ``tolerance``) gets the coefficient 0.
    """
    n, zero = len(inputs), F.lit(0.0)
    out = moments
    for j in range(n):
        left = F.col(f"_c_{j}_{j}")
        for k in range(j):
            left = left - F.col(f"_l_{j}_{k}") * F.col(f"_l_{j}_{k}") * F.col(f"_d_{k}")
        out = out.withColumn(f"_d_{j}", F.when(left > F.col(f"_c_{j}_{j}") * tolerance, left).otherwise(zero))
        below = {}
        for i in range(j + 1, n):
            cell = F.col(f"_c_{j}_{i}")
            for k in range(j):
                cell = cell - F.col(f"_l_{i}_{k}") * F.col(f"_l_{j}_{k}") * F.col(f"_d_{k}")
            below[f"_l_{i}_{j}"] = F.when(F.col(f"_d_{j}") > 0, cell / F.col(f"_d_{j}")).otherwise(zero)
        rest = F.col(f"_y_{j}")
        for k in range(j):
            rest = rest - F.col(f"_l_{j}_{k}") * F.col(f"_z_{k}")
        out = out.withColumns({**below, f"_z_{j}": rest})
    for j in reversed(range(n)):
        share = F.when(F.col(f"_d_{j}") > 0, F.col(f"_z_{j}") / F.col(f"_d_{j}")).otherwise(zero)
        for i in range(j + 1, n):
            share = share - F.col(f"_l_{i}_{j}") * F.col(f"_b_{i}")
        out = out.withColumn(f"_b_{j}", share)
    return out


def linear_fit(rows: DataFrame, keys: Sequence[str], target: str, inputs: Sequence[str], fit_on: Column | None = None,
               tolerance: float = 1e-9) -> DataFrame:
    """Least squares of ``target`` on several inputs per key: ``coefficients`` in order of ``inputs``, ``intercept``, ``fitted_on``.

    The normal equations are covariances, one aggregate that is summed map-side and merged, so a key's rows never meet in one
    task; what follows works on one row per key. Only rows with the target, all inputs and ``fit_on`` count; a key with none
    has no fit. Inputs that others explain, and constant ones, get 0, so that as few as one row give a fit: its mean.
    """
    known = F.col(target).isNotNull() if fit_on is None else F.col(target).isNotNull() & F.coalesce(fit_on, F.lit(False))
    for name in inputs:
        known = known & F.col(name).isNotNull()
    n = len(inputs)
    moments = rows.where(known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fitted_on"), F.avg(target).alias("_y"),
        *[F.avg(name).alias(f"_m_{i}") for i, name in enumerate(inputs)],
        *[F.covar_pop(name, target).alias(f"_y_{i}") for i, name in enumerate(inputs)],
        *[F.covar_pop(inputs[i], inputs[j]).alias(f"_c_{i}_{j}") for i in range(n) for j in range(i, n)],
    )
    solved = _solved(moments, inputs, tolerance)
    level = F.col("_y")
    for i in range(n):
        level = level - F.col(f"_b_{i}") * F.col(f"_m_{i}")
    return solved.select(*keys, F.array(*[F.col(f"_b_{i}") for i in range(n)]).alias("coefficients"), level.alias("intercept"), "fitted_on")


def linear_forecast(rows: DataFrame, fit: DataFrame, keys: Sequence[str], inputs: Sequence[str], name: str) -> DataFrame:
    """Add a fit's prediction; NULL where an input is missing or the key has no fit. All rows stay."""
    made = F.col("_fit.intercept")
    for i, column in enumerate(inputs):
        made = made + F.col("_fit.coefficients")[i] * F.col(column)
    boxed = fit.select(*keys, F.struct("coefficients", "intercept").alias("_fit"))
    return rows.join(boxed, list(keys), "left").withColumn(name, made).drop("_fit")


def upstream_mean(grid: DataFrame, paths: DataFrame, site: str, at: Sequence[str], name: str = "upstream") -> DataFrame:
    """Add the mean value of all upstream sites at the same place in time (``at``); NULL where none has one.

    ``paths`` holds every (src, dst) of the flow graph's closure, each once.
    """
    above = paths.select(F.col("src").alias(site), F.col("dst").alias("_below"))
    seen = grid.where("value IS NOT NULL").join(above, site).groupBy(F.col("_below").alias(site), *at).agg(F.avg("value").alias(name))
    return grid.join(seen, [site, *at], "left")


def scale_by(df: DataFrame, groups: Sequence[str], residual: Column, name: str = "scale", floor: float = 1e-2) -> DataFrame:
    """Predicted spread: the residuals' population deviation per group, floored."""
    return df.groupBy(*groups).agg(F.greatest(F.stddev_pop(residual), F.lit(floor)).alias(name))


def channels(forecast: DataFrame, keys: Sequence[str], stale: int = 4, window: int = 24, calm: int = 8) -> DataFrame:
    """excursion, loo, reconstruction and dispersion per step, NULL where not computable.

    Needs value, pred, age, scale, loo, loo_scale on a complete grid.
    """
    error = F.abs(F.col("value") - F.col("pred")) / F.col("scale")
    out = forecast.withColumns({
        "_err": error, "_carried": F.coalesce("value", "pred"),
        "excursion": F.when(F.col("age") <= stale, error),
        "loo_channel": F.abs(F.col("value") - F.col("loo")) / F.col("loo_scale"),
    })
    out = framed(
        out, keys, "step",
        {
            "reconstruction": lambda w: F.avg("_err").over(w.rowsBetween(-window, -1)),
            "_std": lambda w: F.stddev_pop("_carried").over(w.rowsBetween(-calm, -1)),
            "_seen": lambda w: F.count("value").over(w.rowsBetween(-calm, -1)),
        },
        before=window,
    )
    flatness = F.greatest(
        F.log(F.greatest("scale", F.lit(1e-3)) / F.greatest("_std", F.lit(1e-3))), F.lit(0.0)
    )
    return out.withColumn("dispersion", F.when(F.col("_seen") >= calm // 2, flatness)).drop(
        "_err", "_carried", "_std", "_seen"
    )


def supervised(grid: DataFrame, keys: Sequence[str], width: int = 24) -> DataFrame:
    """Per anchor: the ``width`` steps before it as an array of (step, value, observed), and the target."""
    cell = F.struct(
        "step", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("observed")
    )
    out = framed(
        grid, keys, "step",
        {"inputs": lambda w: F.collect_list(cell).over(w.rowsBetween(-width, -1))}, before=width,
    )
    return out.where(F.size("inputs") == width).select(*keys, "step", "inputs", F.col("value").alias("target"))
