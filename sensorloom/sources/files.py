"""File feeds: delimited logger files of unknown dialect, event folders, JSON responses, chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The time columns a logger file may use, the first present wins.
TIME_COLUMNS = ("DateTimeUTC", "timestamp", "datetime")
DELIMITERS = ("\t", ",", ";")


def flexible_readings(spark: SparkSession, path: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(site, col, time, value) from delimited files, each with its own delimiter and columns.

    The header line of each file settles its delimiter and names; every other line is cut by them into
    rows, so wide files of any shape land in one long frame. Unreadable stamps and values are dropped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    has_time = F.lit(False)
    for name in TIME_COLUMNS:
        has_time = has_time | F.col("value").rlike(rf"(^|[\t,;]){name}([\t,;]|$)")
    seps = [
        (F.size(F.split("value", sep if sep != "\t" else "\\t")) - 1, F.lit(sep)) for sep in DELIMITERS
    ]
    most = F.array_max(F.array(*[F.struct(n.alias("n"), s.alias("s")) for n, s in seps]))["s"]
    heads = (
        lines.where(has_time).withColumn("sep", most)
        .withColumn("names", F.transform(F.split("value", F.col("sep")), lambda c: F.trim(c)))
        .groupBy("file").agg(F.first("sep").alias("sep"), F.first("names").alias("names"))
        .withColumn("stamp", F.coalesce(*[
            F.when(F.array_contains("names", t), F.array_position("names", t).cast("int")) for t in TIME_COLUMNS
        ]))
    )
    cells = lines.where(~has_time).join(heads, "file").withColumn("cells", F.split("value", F.col("sep")))
    time = F.try_to_timestamp(F.trim(F.element_at("cells", F.col("stamp"))))
    long = cells.withColumn("time", time).where("time IS NOT NULL").select(
        site_of(F.col("file"), aliases).alias("site"), "time", "stamp",
        F.posexplode(F.arrays_zip("names", "cells")).alias("pos", "cell"),
    )
    value = F.expr("try_cast(trim(cell.cells) AS DOUBLE)")
    return long.where("pos + 1 <> stamp").select(
        "site", F.col("cell.names").alias("col"), "time", value.alias("value")
    ).where("value IS NOT NULL AND NOT isnan(value)")


def site_of(file: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Site from a file name (or its folder ``site=...``), through the known other names."""
    folder = F.regexp_extract(file, r"site=([^/]+)/", 1)
    stem = F.regexp_extract(file, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    name = F.when(folder != "", folder).otherwise(stem)
    if not aliases:
        return name
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, name), name)


def write_event_folder(rows: DataFrame, path: str) -> None:
    """Rows in folders by day and site; a busy site is spread over tasks by time."""
    placed = rows.withColumn("day", F.to_date("time"))
    placed.repartitionByRange("site", "time").write.mode("append").partitionBy("day", "site").parquet(path)


def event_folder(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of a folder by day and site bounded to [start, end]: other days' folders are not opened.

    Rows without a time are in no range.
    """
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    days = F.col("day").between(F.to_date(low), F.to_date(high))
    return spark.read.parquet(path).where(days & F.col("time").between(low, high)).drop("day")


def split_weather(rows: DataFrame, weather: Sequence[str], at: str = "time") -> tuple[DataFrame, DataFrame]:
    """(rows without the weather columns, weather per moment) where every site's file carries the weather.

    Sites that disagree on a moment's weather give its largest value; a moment no site has weather for has no row.
    """
    carried = [c for c in weather if c in rows.columns]
    some = F.coalesce(*[F.col(c).cast("double") for c in carried]).isNotNull() if carried else F.lit(False)
    sky = rows.where(some & F.col(at).isNotNull()).groupBy(at).agg(
        *[(F.max(c) if c in carried else F.lit(None)).cast("double").alias(c) for c in weather]
    )
    return rows.drop(*carried), sky


def jdbc_readings(spark: SparkSession, url: str, tables: Sequence[str], channels: Sequence[str], start: str, end: str,
                  parts: Sequence[str] = (), **options: str) -> DataFrame:
    """One relational table per site, columns discovered, the time range pushed to the database."""
    out = None
    for table in tables:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
        found = (
            spark.read.jdbc(url, table, predicates=list(parts), properties=dict(options)) if parts else reader.load()
        )
        kept = found.select("time", *[c for c in channels if c in found.columns]).where(
            F.col("time").between(start, end)
        ).withColumn("site", F.lit(table))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


PARALLEL = "struct<hourly:struct<time:array<string>,rain_mm:array<double>,air_temp_c:array<double>>>"


def weather_arrays(responses: DataFrame, body: str = "body", schema: str = PARALLEL) -> DataFrame:
    """Rows of a weather response that answers in parallel arrays."""
    parsed = responses.select(F.from_json(body, schema).alias("r"))
    rows = parsed.select(F.inline(F.arrays_zip("r.hourly.time", "r.hourly.rain_mm", "r.hourly.air_temp_c")))
    return rows.select(F.to_timestamp("time").alias("time"), "rain_mm", "air_temp_c")


FEATURES = "struct<features:array<struct<properties:struct<timestamp:string,temperature:struct<value:double>>>>>"


def observation_features(responses: DataFrame, body: str = "body") -> DataFrame:
    """Rows of nested observation features."""
    feature = responses.select(F.explode(F.from_json(body, FEATURES)["features"]).alias("f"))
    return feature.select(
        F.to_timestamp("f.properties.timestamp").alias("time"), F.col("f.properties.temperature.value").alias("air_temp_c")
    ).where("time IS NOT NULL")


def monthly_chunks(chunks: Sequence[DataFrame], at: str, order: Sequence[str]) -> DataFrame:
    """Overlapping month chunks as one series, the first chunk's row winning per stamp."""
    merged = None
    for i, chunk in enumerate(chunks):
        placed = chunk.withColumn("_chunk", F.lit(i))
        merged = placed if merged is None else merged.unionByName(placed)
    rest = [c for c in chunks[0].columns if c != at]
    return merged.groupBy(at).agg(F.min_by(F.struct(*rest), F.struct("_chunk", *order)).alias("_r")).select(at, "_r.*")


def to_long(wide: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Wide channels to (ids, col, value) rows, finite values only."""
    long = wide.unpivot(list(ids), list(channels), "col", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def to_wide(long: DataFrame, ids: Sequence[str], channels: Sequence[str], col: str = "col") -> DataFrame:
    """(ids, col, value) rows to one column per channel: one shuffle whatever the channel count."""
    return long.groupBy(*ids).pivot(col, list(channels)).agg(F.first("value"))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, NaN and infinities as null."""
    clean = [
        F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))


def export_local(df: DataFrame, path: str, zone: str = "America/Los_Angeles") -> None:
    """Picked readings as CSV in local time."""
    df.withColumn("time", F.date_format(F.from_utc_timestamp("time", zone), "yyyy-MM-dd HH:mm:ss")).write.csv(path, header=True)
