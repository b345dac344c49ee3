"""Control charts, frames and tails against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import clock, stats
from sensorloom.operators import charts, frames, grid, rain, tails


def walk(n=900, seed=5, gaps=((100, 108), (300, 309), (500, 540))):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=n)
    for lo, hi in gaps:
        z[lo:hi] = np.nan
    return z


def to_df(spark, z, name="z"):
    rows = [("s", i, None if math.isnan(v) else float(v)) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, f"site string, step bigint, {name} double")


def stretches(z, reset=8):
    """Real values of a series, cut where more than ``reset`` are missing in a row."""
    at = np.flatnonzero(~np.isnan(z))
    return [z[part] for part in np.split(at, np.flatnonzero(np.diff(at) > reset + 1) + 1)]


def largest_sums(x):
    """For each end the largest sum of a segment that ends there, the empty one included."""
    total = np.concatenate([[0.0], np.cumsum(x)])
    sums = total[1:, None] - total[None, :]
    ends, begins = np.indices(sums.shape)
    return np.where(begins <= ends + 1, sums, -np.inf).max(axis=1)


def weighted_averages(x, lam):
    ends, at = np.indices((len(x), len(x)))
    return np.where(at <= ends, lam * (1 - lam) ** np.maximum(ends - at, 0), 0.0) @ x


def expected_charts(z, k=0.5, lam=0.2):
    parts = stretches(z)
    cusum = np.concatenate([np.maximum(largest_sums(x - k), largest_sums(-x - k)) for x in parts])
    ewma = np.concatenate([np.abs(weighted_averages(x, lam)) for x in parts]) / math.sqrt(lam / (2 - lam))
    return cusum, ewma


def test_closed_form_charts_equal_sums_over_all_segments(spark):
    z = walk()
    df = to_df(spark, z)
    cusum, ewma = expected_charts(z)
    got = charts.cusum(df, ["site"]).toPandas().sort_values("step")
    np.testing.assert_allclose(got["cusum"], cusum, atol=1e-9)
    got = charts.ewma(df, ["site"], block=256, reach=256).toPandas().sort_values("step")
    np.testing.assert_allclose(got["ewma"], ewma, atol=1e-9)


def test_cusum_carries_over_chunks(spark):
    from sensorloom.operators.scale import above_low

    z = walk(gaps=())
    df = to_df(spark, z)
    got = above_low(df, ["site"], "step", {"high": F.col("z") - 0.5}, size=13).toPandas().sort_values("step")
    np.testing.assert_allclose(got["high"], largest_sums(z - 0.5), atol=1e-9)


def test_level_leaves_its_own_step_out_and_needs_a_long_series(spark):
    values = np.arange(60, dtype=float)
    values[20:26] = np.nan
    got = frames.level(to_df(spark, values, "value"), ["site"], 8).toPandas().sort_values("step")
    for i in (8, 15, 22, 40):
        past = values[max(0, i - 8): i]
        want = np.nanmedian(past) if np.isfinite(past).sum() >= 6 else None
        assert got["level"].iloc[i] == want if want is not None else pd.isna(got["level"].iloc[i])
    short = frames.level(to_df(spark, np.arange(8.0), "value"), ["site"], 8).toPandas()
    assert short["level"].isna().all()


def test_hampel_includes_its_own_step(spark):
    v = walk(80, 9, gaps=((30, 33),))
    got = frames.hampel(to_df(spark, v, "value"), ["site"], F.lit(0.05)).toPandas().sort_values("step")
    for i in range(80):
        window = v[max(0, i - 12): i + 1]
        window = window[~np.isnan(window)]
        if np.isnan(v[i]) or len(window) < 10:
            assert pd.isna(got["hampel"].iloc[i])
            continue
        m = np.median(window)
        mad = max(np.median(np.abs(window - m)) * 1.4826, 0.05)
        assert got["hampel"].iloc[i] == pytest.approx(abs(v[i] - m) / mad)


def test_gap_fill_takes_the_head_of_a_long_gap(spark):
    v = np.array([1.0, np.nan, 3.0, np.nan, np.nan, np.nan, np.nan, 8.0, np.nan])
    got = grid.fill_short_gaps(to_df(spark, v, "value"), ["site"], 2).toPandas().sort_values("step")["filled"]
    assert got.tolist()[:5] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert got.isna().tolist()[5:] == [True, True, False, True]


def test_rain_modes_separate_a_delayed_pulse(spark):
    rows = [(i, 1.0 if i == 10 else 0.0) for i in range(80)]
    df = spark.createDataFrame(rows, "step bigint, rain double")
    wet = rain.wetness(df, 3600)
    total, dry = F.col("total"), F.col("dry_hours")
    got = wet.select("step", *[rain.multiplier(m, total, dry).alias(f"{m}_mode") for m in ("off", "step", "decay", "deployed")])
    at = {r.step: r for r in got.collect()}
    assert at[5].decay_mode == at[5].deployed_mode == 1.0
    assert (at[22].step_mode, at[23].step_mode) == (2.0, 1.0)
    assert at[31].decay_mode == pytest.approx(1 + (1 - 21 / 36)) and at[31].deployed_mode == pytest.approx(1.75)
    assert at[79].decay_mode == at[79].deployed_mode == 1.0


def test_fired_ignores_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,), (1.0,)], "s double")
    assert [r[0] for r in df.select(rain.fired(F.col("s"), F.lit(2.0))).collect()] == [False, False, True, False]


def profile_fit(y, positive=True):
    """Brute force: best s on a dense grid."""
    best = (-math.log(y.mean()) - 1.0, y.mean(), 0.0)
    grid = np.exp(np.linspace(math.log(1e-6 / y.mean()), math.log(1e3 / y.mean()), 40001))
    if not positive:
        grid = np.concatenate([grid, -np.linspace(1e-6, 1 - 1e-6, 20001) / y.max()])
    for s in grid:
        g = np.log1p(s * y).mean()
        if g <= -1:
            continue
        ll = -math.log(g / s) - g - 1
        if ll > best[0]:
            best = (ll, g / s, g)
    return best


@pytest.mark.parametrize("shape,positive", [(0.3, True), (-0.3, False), (-0.3, True)])
def test_gpd_fit_reaches_the_brute_force_likelihood(spark, shape, positive):
    rng = np.random.default_rng(11)
    u = rng.uniform(size=400)
    y = 2.0 * ((1 - u) ** (-shape) - 1) / shape
    df = spark.createDataFrame([("k", float(v)) for v in y], "k string, excess double")
    got = tails.fit_gpd(df, ["k"], bounded=not positive).collect()[0]
    ll, sigma, gamma = profile_fit(y, positive)
    assert got.sigma == pytest.approx(sigma, rel=2e-3) and got.gamma == pytest.approx(gamma, abs=2e-3)


def test_pvalues_count_the_null(spark):
    rng = np.random.default_rng(2)
    null, asked = rng.exponential(size=300).round(2), rng.exponential(size=50).round(2)
    samples = spark.createDataFrame([("c", float(v)) for v in null], "channel string, score double")
    scores = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(asked)], "channel string, i int, score double")
    none = spark.createDataFrame([("c", 300, None, None, None, None)], "channel string, n bigint, u double, sigma double, gamma double, tail_p double")
    got = {r.i: r.p for r in tails.pvalues(scores, samples, none, ["channel"], "score", 0.1).collect()}
    for i, v in enumerate(asked):
        assert got[i] == pytest.approx((1 + (null >= v).sum()) / 301)


def test_threshold_and_rate_are_inverse(spark):
    t, sigma, share = F.lit(2.0), F.lit(1.5), F.lit(0.02)
    df = spark.range(1)
    for gamma in (0.0, 0.2, -0.2):
        line = stats.threshold_for(t, sigma, F.lit(gamma), F.lit(1e-4) / share)
        assert df.select(stats.rate_for(t, sigma, F.lit(gamma), share, line)).collect()[0][0] == pytest.approx(1e-4)


def test_erf_and_chi_square(spark):
    df = spark.range(1)
    for x in (-7.0, -2.5, -0.3, 0.0, 0.7, 3.9, 5.5):
        assert df.select(stats.erf(F.lit(x))).collect()[0][0] == pytest.approx(math.erf(x), abs=1e-12)
    assert df.select(stats.chi2_sf_even(F.lit(3.0), 1)).collect()[0][0] == pytest.approx(math.exp(-1.5))


def test_local_slots_follow_the_clock_change(spark):
    stamps = ["2025-03-09 09:59:00", "2025-03-09 10:01:00", "2025-11-02 08:30:00", "2025-11-02 09:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp("s").alias("t"))
    assert [r[0] for r in df.select(clock.slot_of("t")).collect()] == [7, 12, 6, 6]
