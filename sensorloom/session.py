"""Session helpers: the settings the operators rely on, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sensorloom", cores: str = "8") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, from spark.checkpoint.dir; only a one-machine session may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sensorloom-checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder for a table a job writes and reads again."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterated plan in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_LEVELS: dict[tuple, DataFrame] = {}


def level(spark: SparkSession, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived level (grid, residuals, flags, scores) written once per session and read by many.

    Deep plans branch: a level read by four operators would otherwise be planned and run four times.
    """
    key = (spark.sparkContext.applicationId, *name)
    if key not in _LEVELS:
        _LEVELS[key] = checkpoint(make())
    return _LEVELS[key]


def forget_levels() -> None:
    """Drop the handles, so that the next query builds its levels itself (the bench does this)."""
    _LEVELS.clear()
