"""The rank index against sorting every window."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sensorloom.functions.stats import MAD_SCALE
from sensorloom.operators import frames, sliding


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.integers(-4, 4).map(float), st.sampled_from([np.inf, -np.inf, np.nan, -0.0])), max_size=70),
    st.integers(-20, 20), st.integers(0, 30),
)
def test_index_equals_sorting(cells, first, width):
    present = np.array([c is not None for c in cells], dtype=bool)
    values = np.array([0.0 if c is None else c for c in cells], dtype=float)
    low, high = sliding.window(len(cells), first, first + width)
    with np.errstate(invalid="ignore"):
        got, seen = sliding.RankIndex(values, present).medians(low, np.maximum(low, high))
    for i, (a, b) in enumerate(zip(low, high)):
        want = np.sort(values[a:b][present[a:b]])
        assert seen[i] == len(want)
        if len(want):
            with np.errstate(invalid="ignore"):
                np.testing.assert_equal(got[i], (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2.0)


def rows_of(n, seed, gaps=0.2):
    rng = np.random.default_rng(seed)
    return [None if rng.random() < gaps else float(v) for v in rng.normal(size=n).round(1)]


def made(spark, series):
    rows = [(k, i, v, "own") for k, cells in series.items() for i, v in enumerate(cells)]
    return spark.createDataFrame(rows, "k string, step bigint, value double, outlier_note string").repartition(5)


def by_key(df, name):
    out = {}
    for r in df.orderBy("step").collect():
        out.setdefault(r.k, []).append(r[name])
    return out


def middle(cells):
    there = [c for c in cells if c is not None]
    return float(np.median(there)) if there else None


@pytest.fixture(scope="module")
def series():
    return {"a": rows_of(900, 1), "b": rows_of(33, 2), "c": [None] * 50, "d": [1.0] * 120, None: rows_of(130, 3, 0.6)}


def test_wide_trailing_median_over_block_borders(spark, series, monkeypatch):
    monkeypatch.setattr(sliding.per_block, "__defaults__", (64,))
    got = by_key(frames.trailing_median(made(spark, series), ["k"], 40), "median")
    for k, cells in series.items():
        assert got[k] == pytest.approx([middle(cells[max(0, i - 39): i + 1]) for i in range(len(cells))])


def test_wide_and_narrow_levels_agree(spark, series, monkeypatch):
    wide = by_key(frames.level(made(spark, series), ["k"], 48, 0.5), "level")
    monkeypatch.setattr(frames, "WIDE", 10**9)
    assert wide == by_key(frames.level(made(spark, series), ["k"], 48, 0.5), "level")
    assert any(v is not None for v in wide["a"]) and not any(v is not None for v in wide["b"])


def test_centred_outliers_over_block_borders(spark, series, monkeypatch):
    monkeypatch.setattr(sliding.per_block, "__defaults__", (100,))
    got = by_key(frames.centred_outlier(made(spark, series), ["k"], "step", 1.5, 24), "outlier")
    for k, cells in series.items():
        near = lambda xs, i: xs[max(0, i - 12): i + 12]
        own = [middle(near(cells, i)) for i in range(len(cells))]
        apart = [None if c is None else abs(c - m) for c, m in zip(cells, own)]
        assert got[k] == [
            None if a is None else a > middle(near(apart, i)) * (1.5 * MAD_SCALE) for i, a in enumerate(apart)
        ]
    assert set(got["d"]) == {False} and set(got["c"]) == {None}


def test_an_empty_series_and_blocks_of_bounded_rows(spark):
    empty = made(spark, {"a": [1.0]}).where("false")
    assert frames.centred_outlier(empty, ["k"], "step", 3.0).count() == 0
    placed = sliding.spread(made(spark, {"a": rows_of(900, 1)}), "step", 96, 96, 128)
    assert placed.groupBy("_block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 128 + 2 * 96
