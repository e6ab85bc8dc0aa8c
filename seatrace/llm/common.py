"""Helpers shared by the operators: reading tables, shared scratch tables, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is made only for a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs only the steps after it, and lets one pass over the
    texts feed several later steps. ``discard`` removes a table of which nothing that isn't written
    is still made.
    """
    spark = df.sparkSession
    if _own_dir(spark) not in _CLEARED:
        _CLEARED.add(_own_dir(spark))
        atexit.register(_clear_at_exit, spark)
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(*names: str) -> list[str]:
    """Names for columns of a plan's own, which no input column has."""
    return [f"{name}_{uuid.uuid4().hex[:16]}" for name in names]


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``scratch`` wrote, for which all that is made of them must be written before."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if not folder.rpartition("/")[0].endswith(_own_dir(spark).rpartition("/")[2]):
                raise ValueError(f"{folder} is no scratch table")
            _remove(spark, folder)
    if tables:
        free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go now: they do once the driver collects what refers to them, and a
    step that has just ended is still referred to for a moment."""
    for _ in range(2):
        time.sleep(0.1)
        spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results that are made of them must be written before.

    Called when the driver ends, too, if it still can."""
    _remove(spark, _own_dir(spark))


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # the session or its connection has ended before: the folder is left to its owner
        pass


_CLEARED: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/seatrace-{spark.sparkContext.applicationId}"


#: Rows up to which a table of a few longs is broadcast.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count finds it small; its join is a shuffled one otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


#: Bytes of text that a task turns into Python objects at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text, so that a task's memory doesn't follow its texts."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, stop - at)
            at, before = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()
