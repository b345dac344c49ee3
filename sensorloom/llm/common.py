"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.session import scratch

#: Bytes of text that are cut into words at once.
SLICE = 250_000
#: Texts of an Arrow batch at most: by default a batch has 10,000, which are hundreds of MB outside the heap where texts are long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: ASCII letters, for lower-casing that every engine does alike.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it: lineage ends, lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> DataFrame:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver has collected garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Let the system have the memory that a task of a Python worker no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_rows(
    df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]
) -> DataFrame:
    """``make`` over Arrow batches; it returns one batch for each. Lowers the session's rows per Arrow batch to ``BATCH_ROWS``."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make(batch)
        give_back()  # workers live on

    return df.mapInArrow(run, schema)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into runs of at most ``limit`` together; a larger one stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[list[bytes]]:
    """UTF-8 bytes of a string column in runs of at most ``limit`` bytes, so that little is held at once."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield encoded(column.slice(a, b - a))


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
