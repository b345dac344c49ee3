"""A Python data source over readings kept in one folder per site and day.

``site_folder`` reads a feed in full, in part, or as its files arrive:

* batch: comparisons of ``us`` and ``site`` with constants are pushed down; folders of other sites and days are no
  partition at all, and what is left of the range goes to the row groups of each file.
* stream: an offset is the last file read, in order of modification time and path, so a restart goes on after it and
  files that come late for an old day are read too.

Options: ``path``, ``start`` and ``end`` (epoch microseconds, both included), ``bytesPerPartition`` (files are read
together up to that many bytes; a file is never cut), ``settle`` (seconds a file must be old before a stream reads it,
for stores that show files out of order). The path is a URI that pyarrow opens (file, hdfs, s3, gs) on every executor.
Rows without a site or a time are read where no bound asks for one. Extra columns in the files are left unread.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual,
)

NAME = "site_folder"
SCHEMA = "site string, variable string, us bigint, value double"
DAY_US = 86_400_000_000
NONE = "__HIVE_DEFAULT_PARTITION__"
FIRST = {"changed": -1, "file": ""}


@dataclass(frozen=True)
class Stored:
    """One file of the feed: where it is, which site and day it holds, when it came."""

    path: str
    site: str | None
    day: int | None
    size: int
    changed: int

    @property
    def place(self) -> tuple[int, str]:
        return self.changed, self.path


@dataclass
class Part(InputPartition):
    """Files of one task, and the range of times wanted from them."""

    files: tuple[Stored, ...]
    low: int | None
    high: int | None


def _store(path: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[Stored]:
    """All data files under the folder, by modification time and path."""
    from pyarrow import fs

    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type != fs.FileType.File or not info.base_name.endswith(".parquet") or info.base_name[0] in "._":
            continue
        folders = dict(part.split("=", 1) for part in info.path.split("/")[:-1] if "=" in part)
        site, day = unquote(folders.get("site", NONE)), folders.get("day", NONE)
        found.append(Stored(info.path, None if site == NONE else site, None if day == NONE else int(day), info.size, info.mtime_ns))
    return sorted(found, key=lambda f: f.place)


def grouped(files: Iterable[Stored], low: int | None, high: int | None, size: int) -> list[Part]:
    """Tasks of about ``size`` bytes, neighbours by site and day together."""
    parts, held, now = [], [], 0
    for file in sorted(files, key=lambda f: (f.site or "", f.day or 0, f.path)):
        if held and now + file.size > size:
            parts.append(Part(tuple(held), low, high))
            held, now = [], 0
        held.append(file)
        now += file.size
    return parts + ([Part(tuple(held), low, high)] if held else [])


def rows(path: str, part: Part) -> Iterator:
    """Arrow batches of a task's files; row groups outside the range are skipped by their statistics."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    store, _ = _store(path)
    wanted = None
    for bound in ([ds.field("us") >= part.low] if part.low is not None else []) + (
        [ds.field("us") <= part.high] if part.high is not None else []
    ):
        wanted = bound if wanted is None else wanted & bound
    plain = pa.schema([("variable", pa.string()), ("us", pa.int64()), ("value", pa.float64())])
    for file in part.files:
        data = ds.dataset(file.path, schema=plain, filesystem=store, format="parquet")
        for batch in data.to_batches(columns=plain.names, filter=wanted, batch_size=8192, batch_readahead=2, fragment_readahead=1):
            if batch.num_rows:
                site = pa.array([file.site] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([site, *batch.columns], ["site", *plain.names])


class _Wanted:
    """What a reader is asked for: a folder, a range of times, some sites."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.low = int(options["start"]) if "start" in options else None
        self.high = int(options["end"]) if "end" in options else None
        self.sites: set | None = None
        self.size = int(options.get("bytesPerPartition", 128 << 20))
        self.settle = float(options.get("settle", 0))

    def at_least(self, us: int) -> None:
        self.low = us if self.low is None else max(self.low, us)

    def at_most(self, us: int) -> None:
        self.high = us if self.high is None else min(self.high, us)

    def among(self, sites) -> None:
        self.sites = set(sites) if self.sites is None else self.sites & set(sites)

    def holds(self, file: Stored) -> bool:
        if self.sites is not None and file.site not in self.sites:
            return False
        if self.low is None and self.high is None:
            return True
        return (
            file.day is not None
            and (self.low is None or file.day >= self.low // DAY_US)
            and (self.high is None or file.day <= self.high // DAY_US)
        )

    def parts(self, files: Iterable[Stored]) -> list[Part]:
        return grouped([f for f in files if self.holds(f)], self.low, self.high, self.size)


class SiteFolderReader(DataSourceReader):
    """One pass over the folder."""

    def __init__(self, options) -> None:
        self.wanted = _Wanted(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        ask = self.wanted
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("us",) and isinstance(f, EqualTo):
                ask.at_least(f.value)
                ask.at_most(f.value)
            elif name == ("us",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                ask.at_least(f.value + isinstance(f, GreaterThan))
            elif name == ("us",) and isinstance(f, (LessThan, LessThanOrEqual)):
                ask.at_most(f.value - isinstance(f, LessThan))
            elif name == ("site",) and isinstance(f, EqualTo):
                ask.among([f.value])
            elif name == ("site",) and isinstance(f, In):
                ask.among(v for v in f.value if v is not None)
            else:
                yield f

    def partitions(self) -> list[Part]:
        return self.wanted.parts(listed(self.wanted.path))

    def read(self, partition: Part | None) -> Iterator:
        return rows(self.wanted.path, partition) if partition else iter(())


class SiteFolderStream(DataSourceStreamReader):
    """The folder's files as they arrive."""

    def __init__(self, options) -> None:
        self.wanted = _Wanted(options)

    def _settled(self) -> list[Stored]:
        until = time.time_ns() - int(self.wanted.settle * 1e9)
        return [f for f in listed(self.wanted.path) if not self.wanted.settle or f.changed <= until]

    def initialOffset(self) -> dict:
        return dict(FIRST)

    def latestOffset(self) -> dict:
        files = self._settled()
        return {"changed": files[-1].changed, "file": files[-1].path} if files else dict(FIRST)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, upto = (start["changed"], start["file"]), (end["changed"], end["file"])
        return self.wanted.parts(f for f in listed(self.wanted.path) if after < f.place <= upto)

    def read(self, partition: Part) -> Iterator:
        return rows(self.wanted.path, partition)


class SiteFolder(DataSource):
    """Readings in folders ``site=.../day=...``, ``day`` counted from the epoch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SiteFolderReader:
        return SiteFolderReader(self.options)

    def streamReader(self, schema) -> SiteFolderStream:
        return SiteFolderStream(self.options)


def register(spark: SparkSession) -> None:
    """Make ``site_folder`` known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SiteFolder)


def write(readings: DataFrame, path: str, per_file: int = 4_000_000) -> None:
    """Readings into the folder layout; a busy site is spread over tasks by time."""
    placed = readings.select("site", "variable", "us", "value", F.floor(F.col("us") / DAY_US).alias("day"))
    placed.repartitionByRange("site", "us").write.mode("append").option("maxRecordsPerFile", per_file).partitionBy("site", "day").parquet(path)


def batch(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(path=path, **options).load()
