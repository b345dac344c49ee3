"""The custom source: what reaches it, what it reads, and that a stream reads each row once."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

from sensorloom.sources import replay
from sensorloom.streaming import jobs

DAY = replay.DAY_US
SCHEMA = "site string, variable string, us bigint, value double"


def feed(spark, days=range(6), sites=("a", "b/c", "d")):
    rows = [(s, v, d * DAY + 7 * i, float(i)) for s in sites for v in ("x", None) for d in days for i in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    return sorted(map(tuple, df.select("site", "variable", "us", "value").collect()), key=repr)


def test_whole_feed_with_rows_of_no_site_time_or_value(spark, tmp_path):
    odd = spark.createDataFrame([(None, "x", 5, 1.0), ("a", "x", None, 2.0), ("a", "x", 9, None), ("a", "x", 9, None)], SCHEMA)
    given = feed(spark).unionByName(odd).withColumn("day", F.lit("mine"))  # a column named like a folder
    replay.write(given, str(tmp_path / "f"))
    read = replay.batch(spark, str(tmp_path / "f"))
    assert told(read) == told(given)
    assert told(read.where("us >= 0")) == told(given.where("us >= 0"))
    assert told(read.where("site IS NULL OR value IS NULL")) == told(given.where("site IS NULL OR value IS NULL"))


def test_empty_and_absent_folders_have_no_rows(spark, tmp_path):
    assert replay.batch(spark, str(tmp_path / "none")).count() == 0
    replay.write(feed(spark, days=()), str(tmp_path / "f"))
    assert replay.batch(spark, str(tmp_path / "f")).count() == 0


@pytest.mark.parametrize("cond", [
    f"us > {DAY} AND us <= {3 * DAY}", f"us = {2 * DAY + 7}", "site = 'b/c'", f"site IN ('a', 'zz') AND us < {2 * DAY}",
    f"us >= {DAY} AND us < {DAY}", f"us BETWEEN {-5 * DAY} AND -1", f"variable = 'x' AND us > {4 * DAY}", "site = 'a' AND site = 'd'",
])
def test_filters_give_what_a_plain_filter_gives(spark, tmp_path, cond):
    given = feed(spark, days=range(-2, 5))
    replay.write(given, str(tmp_path / "f"))
    assert told(replay.batch(spark, str(tmp_path / "f")).where(cond)) == told(given.where(cond))


def test_range_and_sites_leave_other_folders_out_of_the_partitions(spark, tmp_path):
    path = str(tmp_path / "f")
    replay.write(feed(spark), path)
    reader = replay.SiteFolderReader({"path": path, "bytesPerPartition": "1"})
    every = reader.partitions()
    assert {(f.site, f.day) for p in every for f in p.files} == {(s, d) for s in ("a", "b/c", "d") for d in range(6)}
    left = list(reader.pushFilters([
        GreaterThan(("us",), 2 * DAY - 1), LessThanOrEqual(("us",), 3 * DAY), In(("site",), ("a", "d", None)),
        IsNotNull(("us",)), StringContains(("variable",), "x"),
    ]))
    assert [type(f) for f in left] == [IsNotNull, StringContains]
    kept = reader.partitions()
    assert {(f.site, f.day) for p in kept for f in p.files} == {(s, d) for s in ("a", "d") for d in (2, 3)}
    assert all(len(p.files) == 1 for p in kept) and len(kept) < len(every)
    list(reader.pushFilters([EqualTo(("site",), "zz")]))
    assert reader.partitions() == []


def test_spark_hands_the_filters_over(spark, tmp_path):
    replay.write(feed(spark), str(tmp_path / "f"))
    read = replay.batch(spark, str(tmp_path / "f")).where(f"us BETWEEN {DAY} AND {2 * DAY} AND site = 'a'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert not any(str(DAY) in line for line in left), plan


def test_options_bound_a_batch_and_a_stream_alike(spark, tmp_path):
    path, given = str(tmp_path / "f"), feed(spark)
    replay.write(given, path)
    want = told(given.where(f"us BETWEEN {DAY} AND {3 * DAY}"))
    bounds = {"start": DAY, "end": 3 * DAY}
    assert told(replay.batch(spark, path, **bounds)) == want
    out = jobs.run_now(replay.stream(spark, path, **bounds), "append", str(tmp_path / "o"), str(tmp_path / "m"))
    assert told(out) == want


def test_a_stream_goes_on_after_a_stop_and_reads_late_files(spark, tmp_path):
    path, out, mark = str(tmp_path / "f"), str(tmp_path / "o"), str(tmp_path / "m")
    first, late = feed(spark, days=(3, 4)), feed(spark, days=(0, 3, 5))
    replay.write(first, path)
    assert told(jobs.run_now(replay.stream(spark, path), "append", out, mark)) == told(first)
    assert told(jobs.run_now(replay.stream(spark, path), "append", out, mark)) == told(first)
    replay.write(late, path)
    both = first.unionByName(late)
    assert told(jobs.run_now(replay.stream(spark, path), "append", out, mark)) == told(both)
    assert told(replay.batch(spark, path)) == told(both)


def test_a_batch_of_a_stream_holds_only_files_after_its_start(spark, tmp_path):
    path = str(tmp_path / "f")
    replay.write(feed(spark, days=(0,)), path)
    stream = replay.SiteFolderStream({"path": path})
    one = stream.latestOffset()
    replay.write(feed(spark, days=(1,)), path)
    os.utime(replay.listed(path)[-1].path)
    two = stream.latestOffset()
    days = lambda parts: {f.day for p in parts for f in p.files}
    assert days(stream.partitions(stream.initialOffset(), one)) == {0}
    assert days(stream.partitions(one, two)) == {1} and stream.partitions(two, two) == []
    assert replay.SiteFolderStream({"path": path, "settle": "3600"}).latestOffset() == replay.FIRST
