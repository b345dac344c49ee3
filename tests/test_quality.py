"""Quality tests, levels, life cycle and streams on hand-made series."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom import plugins
from sensorloom.functions import flags
from sensorloom.operators import evaluate, explain, graph, health, levels, lifecycle, quality
from sensorloom.sources import sinks

HOUR = 3_600_000_000


def series(spark, values, spacing=900_000_000):
    rows = [("s", "v", i * spacing, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, variable string, us bigint, n bigint, value double")


KEYS = ["site", "variable"]


def flags_of(df, name="flag"):
    return [r[name] for r in df.orderBy("n").collect()]


def test_worst_follows_severity_not_code(spark):
    df = spark.createDataFrame([(2, 1), (1, 3), (4, 9), (2, 2)], "a int, b int")
    assert [r[0] for r in df.select(flags.worst(F.col("a"), F.col("b"))).collect()] == [1, 3, 9, 2]


def test_gross_range_fails_over_suspect(spark):
    df = series(spark, [5.0, -1.0, 50.0, 500.0, None])
    flag = flags.gross_range(F.col("value"), (F.lit(0.0), F.lit(100.0)), (F.lit(1.0), F.lit(40.0)))
    assert flags_of(df.withColumn("flag", flag)) == [1, 4, 3, 4, 9]


def test_flat_line_breaks_on_gaps(spark):
    df = series(spark, [1.0, 1.0, 1.0, 1.0, None, 1.0, 1.0, 2.0])
    assert flags_of(quality.flat_line(df, KEYS, F.lit(2), F.lit(3), name="flag")) == [1, 1, 3, 4, 9, 1, 1, 1]


def test_attenuated_uses_each_series_own_width(spark):
    rng = np.random.default_rng(4)
    values = [float(x) for x in np.concatenate([rng.normal(0, 10, 20), rng.normal(0, 0.1, 20)])]
    df = series(spark, values)
    for width in (3, 6, 11):
        got = flags_of(quality.attenuated(df, KEYS, F.lit(width), F.lit(1.0), name="flag"))
        want = [3 if i + 1 >= width and np.std(values[i + 1 - width: i + 1], ddof=1) < 1.0 else 1 for i in range(40)]
        assert got == want


def test_attenuated_work_does_not_grow_with_the_window(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    plan = quality.attenuated(df, KEYS, F.lit(3000), F.lit(1.0), F.lit(1.0))._jdf.queryExecution().toString()
    starts = set(re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan))
    assert starts == {"unboundedpreceding$()"}  # running frames only: a sliding one is read anew at every row


def test_attenuated_over_wide_windows_gaps_and_sentinels(spark):
    rng = np.random.default_rng(8)
    calm = np.arange(3000) // 500 % 2
    values = [None if rng.random() < 0.1 else -9999.0 if i in (700, 1900) else float(rng.normal(50, 8 - 7 * calm[i])) for i in range(3000)]
    df = series(spark, values).repartition(4)
    for width in (1, 2, 499, 1000, 2999, 3000, 3001):
        std = flags_of(quality.attenuated(df, KEYS, F.lit(width), F.lit(5.0), name="flag"))
        span = flags_of(quality.attenuated(df, KEYS, F.lit(width).cast("bigint"), min_range=F.lit(30.0), name="flag"))
        for i in range(0, 3000, 7):
            seen = [v for v in values[max(0, i + 1 - width): i + 1] if v is not None]
            judged = i + 1 >= width and len(seen) > 1
            assert std[i] == (9 if values[i] is None else 3 if judged and np.std(seen, ddof=1) < 5.0 else 1)
            assert span[i] == (9 if values[i] is None else 3 if judged and max(seen) - min(seen) < 30.0 else 1)


def test_rate_of_change_holds_the_rate(spark):
    df = series(spark, [0.0, 0.0, 0.0, 10.0, 10.0])
    got = flags_of(quality.rate_of_change(df, KEYS, F.lit(2).cast("bigint"), F.lit(12.0), 3600, name="flag"))
    assert got == [1, 1, 1, 3, 3]  # half the span allows half the change


def test_staleness_and_time_gap(spark):
    df = series(spark, [None, 1.0, None, None, None, 2.0], HOUR)
    assert flags_of(quality.staleness(df, KEYS, 2 * HOUR, 10 * HOUR, name="flag")) == [9, 1, 3, 3, 4, 1]
    assert flags_of(quality.time_gap(df, KEYS, 2 * HOUR, 3 * HOUR, name="flag")) == [9, 4, 9, 9, 9, 4]


def test_first_log_line_wins_and_screen_comes_first(spark):
    rows = [("s", "v", 10, 1.0, 1), ("s", "v", 20, 2.0, 4), ("s", "v", 30, 3.0, 1), ("s", "v", 99, 4.0, 4)]
    screened = spark.createDataFrame(rows, "site string, variable string, us bigint, value double, flag int")
    log = spark.createDataFrame([("s", "v", 3, 15, None), ("s", "v", 2, 25, 35)], "site string, variable string, line int, a bigint, b bigint")
    got = {r.us: r.removed_by for r in levels.review(screened, log, KEYS, 10).collect()}
    assert got == {10: 0, 20: 3, 30: 2, 99: 3}


def test_only_changed_values_become_versions(spark):
    old = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 1)], "us bigint, value double, fetched bigint")
    new = spark.createDataFrame([(1, 5.0, 2), (2, 7.0, 2), (3, 1.0, 2)], "us bigint, value double, fetched bigint")
    assert sorted(r.us for r in sinks.new_versions(old, new, ["us"]).collect()) == [2, 3]


def test_events_group_overlaps_into_one(spark):
    label = [0, 1, 1, 0, 0, 0, 0, 1, 0, 0]
    found = [0, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    rows = [("s", i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(label, found, strict=True))]
    df = spark.createDataFrame(rows, "site string, step bigint, labelled boolean, over boolean")
    numbered = evaluate.number_events(evaluate.number_events(df, ["site"], "labelled", 0, "l"), ["site"], "over", 0, "d")
    classed = evaluate.classify_events(numbered, ["site"], "l", "d")
    assert [r["class"] for r in classed.orderBy("step").collect()] == ["tn", "tp", "tp", "tp", "tn", "fp", "tn", "fn", "tn", "tn"]
    card = evaluate.event_metrics(classed, ["site"]).collect()[0]
    assert (card.tp, card.fp, card.fn, card.precision, card.recall) == (1, 1, 1, 0.5, 0.5)


def test_gap_merging_numbers_the_gap_too(spark):
    rows = [("s", i, i in (2, 4, 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "site string, step bigint, f boolean")
    got = [r.event for r in evaluate.number_events(df, ["site"], "f", gap=1).orderBy("step").collect()]
    assert got == [0, 0, 1, 1, 1, 0, 0, 0, 0, 2, 0, 0]


def test_classification_and_cooldown(spark):
    rows = [("k", 10, 9), ("k", 12, 9), ("k", 14, 13), ("k", 30, 29), ("k", 31, 30), ("k", 36, 35)]
    items = spark.createDataFrame(rows, "key string, checked_at bigint, first_over bigint")
    got = [r.outcome for r in lifecycle.classify(items, ["key"], 6).orderBy("checked_at").collect()]
    assert got == ["new", "same", "repeat", "new", "repeat", "new"]
    got = [r.outcome for r in lifecycle.cooldown(items, ["key"], "checked_at", 6).orderBy("checked_at").collect()]
    assert got == ["sent", "held", "held", "sent", "held", "sent"]


def test_flow_closure_cycles_and_order(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    pairs = {(r.src, r.dst, r.hops) for r in graph.closure(edges).collect()}
    assert pairs == {("a", "b", 1), ("b", "c", 1), ("d", "c", 1), ("a", "c", 2)}
    weights = {(r.src, r.dst): r.weight for r in graph.closure(graph.inflow_weights(edges)).collect()}
    assert weights[("a", "c")] == 0.5
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "src string, dst string")
    assert {r.src for r in graph.cyclic(loop, 4).collect()} == {"a", "b"}
    firsts = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (2, "a", 5), (2, "x", 5), (3, "d", 2)], "run int, site string, first bigint")
    got = {(r.run, r.site): r.verdict for r in explain.order_verdicts(firsts, graph.closure(edges), ["x"], ["run"]).collect()}
    assert got[(1, "a")] == got[(1, "b")] == "transport" and got[(2, "a")] == "not_transport" and got[(3, "d")] == "local"


def test_diffusion_fills_between_neighbours(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (1, "c", 3.0), (2, "a", 4.0), (2, "b", 5.0), (2, "c", 6.0)]
    df = spark.createDataFrame(rows, "step int, site string, value double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {(r.step, r.site): r.filled for r in graph.propagate_missing(df, edges, ["step"], "site", "value").collect()}
    half = 1 / np.sqrt([2, 3, 2])
    assert got[(1, "b")] == pytest.approx((half[1] * half[0] * 1 + half[1] * half[2] * 3) / (1 - half[1] ** 2))
    assert got[(2, "b")] == 5.0


def test_flipping_a_direction_changes_the_diagnosis(spark):
    rain = {"dissolved_oxygen": "up", "ph": "down", "conductivity": "down", "floating_conductivity": "down", "temperature": "flat"}

    def verdict(observed):
        df = spark.createDataFrame([(1, p, d) for p, d in observed.items()], "block int, parameter string, direction string")
        return explain.diagnose(df, ["block"]).collect()[0]

    assert verdict(rain).cause == "rain"
    assert verdict({**rain, "dissolved_oxygen": "down", "temperature": "up"}).cause == "oil"
    assert verdict({"conductivity": "up"}).verdict == "cannot_evaluate"


def test_wasserstein_equals_sorted_quantile_distance(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, 500).round(2), rng.normal(0.4, 1, 500).round(2)
    make = lambda x: spark.createDataFrame([("s", float(v)) for v in x], "site string, value double")
    got = health.wasserstein(make(a), make(b), ["site"], "value", 0.2).collect()[0]
    assert got.distance == pytest.approx(np.abs(np.sort(a) - np.sort(b)).mean())
    assert got.ratio == pytest.approx(got.distance / b.std())


def test_reference_sample_is_fixed_and_sized(spark):
    df = spark.range(3000).select(F.lit("s").alias("site"), F.col("id").alias("seq"))
    one = {r.seq for r in health.reference_sample(df, ["site"], 100).collect()}
    two = {r.seq for r in health.reference_sample(df.repartition(7), ["site"], 100).collect()}
    assert one == two and len(one) == 100


def test_modules_are_checked(spark):
    modules = plugins.Registry()
    modules.module("m", "modulator", lambda: F.lit(2.0))
    with pytest.raises(ValueError, match="already"):
        modules.module("m", "screen", lambda: F.lit(True))
    with pytest.raises(ValueError, match="kind"):
        modules.module("x", "oracle", lambda: F.lit(True))
    modules.detector("d", lambda df: df)
    with pytest.raises(ValueError, match="no column"):
        modules.scores("d", spark.range(1))


def test_reset_screen_of_missing_steps_and_install_dates(spark):
    start = 1_700_000_000_000_000 // (900 * 10**6) * (900 * 10**6)
    step = 900 * 10**6
    rows = [("s", "v", start + i * step + 1000, i, 5.0 + i % 3) for i in range(40) if i not in (10, 11)]
    readings = spark.createDataFrame(rows, "site string, variable string, us bigint, seq bigint, value double")
    sensors = spark.createDataFrame(
        [("s", "v", True, start + 5 * step, None, "feed")],
        "site string, variable string, in_service boolean, install_us bigint, removed_us bigint, source string",
    )
    limits = spark.createDataFrame(
        [("s", "v", False, -1.0, 100.0, 0.0, 50.0, 20.0, 20.0, 0.01)],
        "site string, variable string, has_floor boolean, span_lo double, span_hi double, usual_lo double, usual_hi double, spike_over double, change_over double, calm_std double",
    )
    spine = quality.screening_spine(readings, sensors, KEYS, 86400)
    out = quality.screen(spine, sensors, limits, KEYS, start + 100 * step, 0, 86400).orderBy("us").collect()
    by = {(r.us - start) // step: r for r in out}
    assert [i for i, r in by.items() if r.flag == 9] == [10, 11]
    assert by[2].flag == 2 and by[20].flag == 1 and by[12].time_gap == 1
