"""Multi-input fits against NumPy's least squares, and what odd inputs give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import forecast

SCHEMA = "k string, a double, b double, c double, y double, fit boolean, coefficients string"
INPUTS = ("a", "b", "c")


def table(spark, seed=5, n=400, far=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for key, weights in (("p", (2.0, -1.0, 0.5)), ("q", (0.0, 3.0, -4.0)), (None, (1.0, 1.0, 1.0))):
        x = rng.normal(size=(n, 3)) @ np.array([[1, 0.6, 0.2], [0, 1, 0.9], [0, 0, 1]]) + far
        y = x @ weights + 7 + rng.normal(size=n)
        for i in range(n):
            cells = [None if rng.random() < 0.05 else float(v) for v in (*x[i], y[i])]
            rows.append((key, *cells, None if i % 11 == 0 else i % 3 > 0, "own"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


def by_lstsq(rows, key):
    known = np.array([r[1:5] for r in rows if r[0] == key and r[5] and None not in r[1:5]])
    full = np.column_stack([known[:, :3], np.ones(len(known))])
    return np.linalg.lstsq(full, known[:, 3], rcond=None)[0], len(known)


@pytest.mark.parametrize("far", [0.0, 1e4])
def test_fit_equals_numpy(spark, far):
    rows, df = table(spark, far=far)
    got = {r.k: r for r in forecast.linear_fit(df, [], "y", INPUTS).withColumn("k", F.lit("all")).collect()}
    assert got["all"].fitted_on == sum(None not in r[1:5] for r in rows)
    fit = forecast.linear_fit(df.where("k IS NOT NULL"), ["k"], "y", INPUTS, F.col("fit"))
    for r in fit.collect():
        want, n = by_lstsq(rows, r.k)
        assert r.fitted_on == n
        np.testing.assert_allclose([*r.coefficients, r.intercept], want, rtol=1e-6, atol=1e-6 * max(far, 1))


def test_forecast_keeps_rows_and_has_none_without_inputs_or_fit(spark):
    rows, df = table(spark)
    fit = forecast.linear_fit(df.where("k = 'p'"), ["k"], "y", INPUTS, F.col("fit"))
    out = forecast.linear_forecast(df, fit, ["k"], INPUTS, "made")
    assert out.columns == [*df.columns, "made"] and out.count() == len(rows)
    weights, _ = by_lstsq(rows, "p")
    for r in out.collect():
        if r.k != "p" or None in (r.a, r.b, r.c):
            assert r.made is None
        else:
            assert r.made == pytest.approx(float(np.dot(weights, [r.a, r.b, r.c, 1.0])))


def test_explained_and_constant_inputs_get_zero(spark):
    rows = [("p", float(i), 2.0 * i, 5.0, 3.0 * i + 1, True, "") for i in range(40)]
    one = [("q", 1.0, 2.0, 3.0, 9.0, True, "")]
    fit = {r.k: r for r in forecast.linear_fit(spark.createDataFrame(rows + one, SCHEMA), ["k"], "y", INPUTS).collect()}
    assert fit["p"].coefficients == pytest.approx([3.0, 0.0, 0.0]) and fit["p"].intercept == pytest.approx(1.0)
    assert fit["q"].coefficients == [0.0, 0.0, 0.0] and fit["q"].intercept == 9.0


def test_no_rows_give_no_fit(spark):
    _, df = table(spark, n=3)
    assert forecast.linear_fit(df.where("false"), ["k"], "y", INPUTS).count() == 0
    assert forecast.linear_fit(df, ["k"], "y", INPUTS, F.lit(None).cast("boolean")).count() == 0


def test_one_input_equals_the_built_in_regression(spark):
    _, df = table(spark)
    known = df.where("k = 'q' AND b IS NOT NULL AND y IS NOT NULL")
    want = known.agg(F.regr_slope("y", "b").alias("s"), F.regr_intercept("y", "b").alias("i")).first()
    got = forecast.linear_fit(known, ["k"], "y", ["b"]).first()
    assert (got.coefficients[0], got.intercept) == pytest.approx((want.s, want.i))


def test_upstream_mean_leaves_the_own_site_out(spark):
    grid = spark.createDataFrame(
        [("a", "v", 1, 1.0), ("b", "v", 1, 3.0), ("c", "v", 1, 50.0), ("a", "v", 2, None), ("c", "v", 2, 7.0), ("b", "w", 1, 9.0), ("c", "w", 3, 1.0)],
        "site string, variable string, step bigint, value double",
    )
    paths = spark.createDataFrame([("a", "c"), ("b", "c"), ("a", "b")], "src string, dst string")
    out = {(r.site, r.variable, r.step): r.upstream for r in forecast.upstream_mean(grid, paths, "site", ["variable", "step"]).collect()}
    assert out == {
        ("a", "v", 1): None, ("b", "v", 1): 1.0, ("c", "v", 1): 2.0, ("a", "v", 2): None, ("c", "v", 2): None,
        ("b", "w", 1): None, ("c", "w", 3): None,
    }
