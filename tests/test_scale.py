"""The scale toolkit against plain one-task computations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorloom.operators import scale


def series(spark, n=700, seed=1, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [
        (k, int(i), float(v) if rng.random() > 0.2 else None)
        for k in keys for i, v in enumerate(rng.normal(size=n).round(2))
    ]
    return rows, spark.createDataFrame(rows, "k string, step bigint, value double")


def frame(rows):
    return pd.DataFrame(rows, columns=["k", "step", "value"])


def collected(df):
    return df.toPandas().sort_values(["k", "step"]).reset_index(drop=True)


def test_framed_blocks_equal_one_window(spark):
    rows, df = series(spark)
    out = collected(scale.framed(
        df, ["k"], "step",
        {"m": lambda w: F.avg("value").over(w.rowsBetween(-12, 3))}, before=12, after=3, block=16,
    ))
    want = frame(rows).groupby("k")["value"].apply(
        lambda s: pd.Series([s.iloc[max(0, i - 12): i + 4].mean() for i in range(len(s))])
    ).to_numpy()
    np.testing.assert_allclose(out["m"].to_numpy(dtype=float), want, atol=1e-12)


def test_prefix_kinds_equal_one_pass(spark):
    rows, df = series(spark)
    v = F.col("value")
    out = collected(scale.prefix(
        df, ["k"], "step",
        {"s": ("sum", v), "lo": ("min", v), "l": ("last", v), "p": ("prev", v), "b": ("before", v)}, size=50,
    ))
    pdf = frame(rows)
    by = pdf.groupby("k")["value"]
    np.testing.assert_allclose(out["s"], by.transform(lambda s: s.fillna(0).cumsum()), atol=1e-9)
    np.testing.assert_allclose(out["lo"], by.transform(lambda s: s.cummin().ffill()))
    np.testing.assert_allclose(out["l"], by.transform(lambda s: s.ffill()))
    np.testing.assert_allclose(out["p"], by.transform(lambda s: s.shift()))
    np.testing.assert_allclose(out["b"], by.transform(lambda s: s.shift().ffill()))


def test_prefix_in_reverse_finds_the_next_value(spark):
    rows, df = series(spark)
    out = collected(scale.prefix(df, ["k"], "step", {"n": ("before", F.col("value"))}, size=37, reverse=True))
    want = frame(rows).groupby("k")["value"].transform(lambda s: s.shift(-1).bfill())
    np.testing.assert_allclose(out["n"], want)


def test_runs_number_stretches_across_chunks(spark):
    rows, df = series(spark)
    real = df.where("value IS NOT NULL")
    out = collected(scale.runs(real, ["k"], "step", lambda was, now: now - was > 1, size=10, start="s"))
    pdf = frame(rows).dropna()
    breaks = pdf.groupby("k")["step"].diff().ne(1)
    want = breaks.groupby(pdf["k"]).cumsum()
    assert out["run"].tolist() == want.tolist()
    firsts = pdf.assign(run=want).groupby(["k", "run"])["step"].transform("min")
    assert out["s"].tolist() == firsts.tolist()


def test_quantiles_are_exact_on_a_hot_key_and_ties(spark):
    rng = np.random.default_rng(3)
    hot = rng.exponential(50, 5000).round(1)
    flat = np.full(300, 7.0)
    rows = [("hot", float(x)) for x in hot] + [("flat", 7.0) for _ in flat] + [("one", 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"a": 0.0, "q": 0.25, "m": 0.5, "p": 0.987, "z": 1.0}
    got = {r.k: r for r in scale.quantiles(df, ["k"], "x", probs, count="n").collect()}
    assert set(got) == {"hot", "flat", "one"}
    for name, p in probs.items():
        np.testing.assert_allclose(got["hot"][name], np.quantile(hot, p), rtol=1e-12)
        assert got["flat"][name] == 7.0 and got["one"][name] == 1.5
    assert got["hot"]["n"] == 5000


def test_period_join_equals_brute_force(spark):
    facts = [("a", i) for i in range(0, 100, 3)] + [("b", i) for i in range(0, 100, 7)]
    periods = [("a", 10, 40, 1), ("a", 35, 60, 2), ("b", 0, 0, 3), ("b", 90, 200, 4)]
    f = spark.createDataFrame(facts, "k string, t bigint")
    p = spark.createDataFrame(periods, "k string, lo bigint, hi bigint, id int")
    for closed in (True, False):
        got = {(r.k, r.t, r.id) for r in scale.period_join(f, p, ["k"], "t", "lo", "hi", 8, closed).collect()}
        want = {
            (k, t, i) for k, t in facts for q, lo, hi, i in periods
            if k == q and lo <= t and (t <= hi if closed else t < hi)
        }
        assert got == want
