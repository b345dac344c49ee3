"""Event folders: days outside the range are pruned, weather is split off."""

from pyspark.sql import functions as F

from sensorloom.sources import files

SCHEMA = "site string, stamp string, seq bigint, rain_mm double, note string"


def folder(spark, path):
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", d * 100 + h, None if h else float(d), "own") for s in ("a", "b") for d in range(1, 8) for h in (0, 12, 23)]
    df = spark.createDataFrame([*rows, ("a", None, -1, 5.0, "")], SCHEMA).withColumn("time", F.expr("cast(stamp as timestamp)"))
    files.write_event_folder(df, path)


def test_range_is_closed_and_prunes_days(spark, tmp_path):
    folder(spark, str(tmp_path / "e"))
    out = files.event_folder(spark, str(tmp_path / "e"), "2024-01-03 12:00:00", "2024-01-05 00:00:00")
    assert sorted({r.seq for r in out.collect()}) == [312, 323, 400, 412, 423, 500] and out.count() == 12
    plan = out._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in pruned and "2024-01-03" in pruned and "2024-01-05" in pruned
    assert files.event_folder(spark, str(tmp_path / "e"), "2024-01-05", "2024-01-03").count() == 0


def test_weather_is_one_row_a_moment_and_leaves_the_readings(spark, tmp_path):
    folder(spark, str(tmp_path / "e"))
    rows = files.event_folder(spark, str(tmp_path / "e"), "2024-01-01", "2024-02-01")
    own, sky = files.split_weather(rows, ["rain_mm", "air_temp_c"])
    assert "rain_mm" not in own.columns and "note" in own.columns and own.count() == 42
    told = sky.orderBy("time").collect()
    assert [r.rain_mm for r in told] == [float(d) for d in range(1, 8)] and {r.air_temp_c for r in told} == {None}
    own, sky = files.split_weather(rows.drop("rain_mm"), ["rain_mm"])
    assert own.count() == 42 and sky.count() == 0
