"""Streams: what batches hold must not decide what comes out."""

import itertools

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import clock
from sensorloom.operators import evaluate, graph
from sensorloom.operators.quality import TICK, row_clock
from sensorloom.session import scratch
from sensorloom.sources import sinks
from sensorloom.streaming import jobs

VERSIONS = "site string, us bigint, value double, fetched bigint, time timestamp, day bigint"


def versions(spark, rows):
    frame = spark.createDataFrame(rows, "site string, us bigint, value double, fetched bigint")
    return frame.withColumn("time", F.timestamp_micros("us")).withColumn("day", F.lit(0).cast("bigint"))


@pytest.mark.parametrize("cuts", [[[0, 1, 2, 3, 4, 5]], [[0, 1], [2, 3], [4, 5]], [[0], [1], [2], [3], [4], [5]]])
def test_ingest_keeps_every_version_however_files_fall_into_batches(spark, cuts):
    rows = [("a", 1, 1.0, 10), ("a", 1, 2.0, 20), ("a", 1, 2.0, 30), ("a", 1, 1.0, 40), ("a", 2, None, 10), ("a", 2, None, 20)]
    path, table, mark = scratch(spark), scratch(spark), scratch(spark)
    for cut in cuts:
        frame = versions(spark, [rows[i] for i in cut])
        frame.repartition(2).write.mode("append").parquet(path)
        jobs.ingest(jobs.stream(spark, path, frame.schema), table, ["site", "us"], mark=mark)
    got = sorted((r["us"], r["fetched"], r["value"]) for r in spark.read.parquet(table).collect())
    assert got == [(1, 10, 1.0), (1, 20, 2.0), (1, 40, 1.0), (2, 10, None)]


def test_a_batch_run_again_adds_nothing(spark):
    rows = versions(spark, [("a", 1, 1.0, 10), ("a", 1, 2.0, 20), ("b", 1, None, 10)])
    stored = sinks.changed_versions(rows.where("false"), rows, ["site", "us"])
    assert stored.count() == 3 and sinks.changed_versions(stored, rows, ["site", "us"]).count() == 0


def test_windows_of_many_files_per_part_equal_a_batch(spark):
    rows = [("s", i * 400_000_000, float(i % 7)) for i in range(500)]
    frame = spark.createDataFrame(rows, "site string, us bigint, value double").withColumn("time", F.timestamp_micros("us"))
    far = spark.createDataFrame([("beat", 10**12, 0.0)], "site string, us bigint, value double").withColumn("time", F.timestamp_micros("us"))
    parts = [frame.where((F.col("us") >= a) & (F.col("us") < b)).repartition(3) for a, b in itertools.pairwise((0, 60_000_000_000, 10**11, 10**13))]
    got = jobs.replay([*parts, far], lambda df: jobs.tumbling(df, ["site"], "2 hours", late="1 hour")).where("site = 's'")
    want = frame.groupBy((F.floor(F.col("us") / 7_200_000_000) * 7200).alias("second")).agg(F.count("*").alias("readings"), F.max("value").alias("top"))
    assert sorted(map(tuple, got.select("second", "readings", "top").collect())) == sorted(map(tuple, want.collect()))


def test_local_time_follows_the_clock_change(spark):
    hours = spark.range(24).select(F.timestamp_seconds(F.lit(1710054000) + F.col("id") * 3600).alias("t"))  # 10 March 2024, 7:00 UTC on
    rows = hours.select(clock.local_day("t").alias("day"), (clock.slot_of("t") / 4).cast("int").alias("hour")).collect()
    assert [r["hour"] for r in rows[:5]] == [23, 0, 1, 3, 4]
    assert len({r["day"] for r in rows}) == 2 and rows[-1]["hour"] == 23


@pytest.mark.parametrize("width", [1, 3, 1000, 65_537, 200_000, 5_000_000])
def test_row_clock_holds_exactly_its_width(spark, width):
    start = 8_000_000_000
    near = [start - width, start - width + 1, start - 1, start, start + 1]
    rows = spark.createDataFrame([(n,) for n in near], "n bigint").select("n", row_clock(F.col("n"), F.lit(width)).alias("x")).collect()
    at = {r["n"]: r["x"] for r in rows}
    assert at[start] - at[start - width] == TICK > TICK - 16
    assert width == 1 or at[start] - at[start - width + 1] <= TICK - 16


def test_closure_tells_of_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(edges, max_rounds=3)


def test_keys_with_only_labels_or_detections_are_scored(spark):
    rows = [("only labels", i, True, False) for i in range(3)] + [("only detections", i, False, True) for i in range(3)]
    grid = spark.createDataFrame(rows, "site string, step bigint, labelled boolean, over boolean")
    got = {r["site"]: (r["range_precision"], r["range_recall"]) for r in evaluate.range_scores(grid, ["site"], "labelled", "over").collect()}
    assert got == {"only labels": (None, 0.0), "only detections": (0.0, None)}


def test_drift_needs_readings_and_a_reference_that_varies(spark):
    from sensorloom.operators import health

    rows = [("few", float(i)) for i in range(3)] + [("many", float(i)) for i in range(50)]
    now = spark.createDataFrame(rows, "site string, value double")
    still = spark.createDataFrame([("many", 1.0)] * 50 + [("few", 1.0)] * 50, "site string, value double")
    assert {r["site"]: r["ratio"] for r in health.wasserstein(now, still, ["site"], "value", 4.0, need=10).collect()} == {"few": None, "many": None}
    then = now.withColumn("value", F.col("value") + 1)
    got = {r["site"]: r["ratio"] for r in health.wasserstein(now, then, ["site"], "value", 4.0, need=10).collect()}
    assert got["few"] is None and got["many"] > 0
