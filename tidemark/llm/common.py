"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most; with texts of up to about 1 MB a batch stays far below a worker's memory.
BATCH_ROWS = 256
#: Rows of a file, where a table of known size is written, and bytes of a source that a task takes at least.
FILE_ROWS, TASK_BYTES = 20_000, 16 << 20
#: Parts that few() asks for at most; a source of unknown size counts as endless and keeps its own.
MOST_PARTS = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, for one key at a time: a worker serves one stage after another, and what an
    earlier stage or run kept makes way."""
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give a worker's free memory back, as an idle worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function from batch to batch; it sees the columns of df in order."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one is set only where none is, and only on a local master, as in tests."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return shared


def parts_for(source: DataFrame) -> int:
    """How many tasks and files suit what is made from all rows of a source: by its size, and one for each core at least."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(source.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), MOST_PARTS))


def few(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df in no more parts than suit its source (itself, if none is given): small parts become few files. Without a shuffle."""
    return df.coalesce(parts_for(df if source is None else source))


def cut(df: DataFrame, rows: int | None = None, parts: int | None = None) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no lineage.

    rows: how many df has at most, where that is known; parts: how many suit it. Either makes few files of few rows."""
    checkpoint_dir(df.sparkSession)
    parts = parts if rows is None else 1 + rows // FILE_ROWS
    return (df if parts is None else df.coalesce(parts)).checkpoint(eager=True)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
