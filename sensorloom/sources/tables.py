"""The given tables read as sensor data.

``events`` is the readings feed: its type is the site, ``user_id % 3`` the variable, ``event_id`` the
arrival order. Other tables serve as dimensions. Only the needed columns leave the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VARIABLES = ("conductivity", "depth", "temperature")

MICROS = 1_000_000


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical readings: site, variable, time, us (epoch microseconds), seq, value."""
    variable = F.element_at(
        F.array(*[F.lit(v) for v in VARIABLES]), (F.col("user_id") % 3 + 1).cast("int")
    )
    time = F.col("ts").cast("timestamp")
    return load(spark, folder, "events").select(
        F.col("event_type").alias("site"),
        variable.alias("variable"),
        time.alias("time"),
        F.unix_micros(time).alias("us"),
        F.col("event_id").alias("seq"),
        "value",
    )


def faulty_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The readings as a logger with faults would send them: sentinels, dips, and lost values."""
    value = (
        F.when(F.col("seq") % 101 == 0, F.lit(-9999.0))
        .when(F.col("seq") % 53 == 0, F.lit(-20.0))
        .when(F.col("seq") % 59 == 0, F.lit(-40.0))
        .when(F.col("seq") % 61 == 0, F.lit(None))
        .otherwise(F.col("value"))
    )
    return readings(spark, folder).withColumn("value", value)


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The versioned raw level: every reading fetched twice, some with another value the second time."""
    first = readings(spark, folder).withColumn("fetched", F.col("us") + 60 * MICROS)
    second = first.withColumn("fetched", F.col("fetched") + 3600 * MICROS).withColumn(
        "value", F.when(F.col("seq") % 7 == 0, F.col("value") + 1).otherwise(F.col("value"))
    )
    return first.unionByName(second)
