"""Helpers that run a Python function over Arrow batches of a DataFrame."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and one machine does all the work (tests,
    a laptop) is a local one set; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        folder = context._jsc.sc().getCheckpointDir()
        if not folder.isDefined() and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = folder.get() if folder.isDefined() else f"{tempfile.gettempdir()}/marketloom-scratch"
    return f"{root.rstrip('/')}/marketloom-{uuid.uuid4().hex}"


#: Spark's setting that drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, and
    what was shuffled for it can be freed.  The folder is left to the cluster's
    clean-up of spark.checkpoint.dir, as results that read it are lazy."""
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what is shuffled for the table goes with the write
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets the cleaner drop the shuffles behind the table
    return back


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table made by written() that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/marketloom-" in name:
            path = hadoop(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that is free back to the system: idle workers would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def reuse() -> None:
    """Lets this process reuse freed arrays of up to 32 MB; otherwise each may come from the system and
    go back to it, and its pages are faulted in anew, which took half of the time of a bare training loop.
    At most 64 MB of free memory are held between calls of release()."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for option, value in ((-3, 32 << 20), (-1, 64 << 20), (-2, 16 << 20)):  # largest array from the heap, what it may hold free, what it grows by
            libc.mallopt(option, value)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with free memory given back now and then and at the task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for i, out in enumerate(run(batches)):
                yield out
                if i % 8 == 7:
                    release()
        finally:
            release()

    return wrapped


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """df.mapInArrow with a function that make() builds once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(trimmed(run), schema)


def map_groups(
    df: DataFrame,
    keys: list[str],
    make: Callable[[], Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]],
    schema: str,
    order: list[str] | None = None,
    partitions: int | None = None,
    place: Column | None = None,
) -> DataFrame:
    """work(key, rows) for each group of equal keys, one group in memory at a time.

    Groups must be bounded by construction (blocks, hash buckets); rows arrive
    sorted by `order`.  `place` names the partition of a row, one for each key,
    where a hash of few keys would put several into one task and none into others.
    """
    spread = df.repartitionById(partitions, place.cast("int")) if place is not None else df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    sorted_rows = spread.sortWithinPartitions(*keys, *(order or []))
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for k in at:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(batch.column(k)[a].as_py() for k in at)
                if held and now != key:
                    yield from work(key, pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(key, pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(trimmed(run), schema)


def text_of(df: DataFrame, text: str, *keep: str | Column) -> DataFrame:
    """The columns to keep and the text (null stays null)."""
    return df.select(*keep, F.col(text))
