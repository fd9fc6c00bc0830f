"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder, spark.checkpoint.dir; where the session names none, in one below
    the warehouse, which all nodes share as well.

    What the cut lineage alone held is garbage then. The driver is asked to collect it, since Spark deletes shuffle
    files from the executors' disks only when the driver's objects for them are collected.

    What was known of the rows' partitioning, order and size is dropped with the lineage. It would grow with each round
    of an iteration, until planning takes longer than the work, and it would spare a join one of its exchanges. A
    counted or reduced table is written before it is joined by a key that may be hot: then both sides of the join come
    straight from exchanges, and adaptive execution can deal the rows of a large partition to several tasks.
    """
    session = df.sparkSession
    context = session.sparkContext
    if not session.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{session.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    kept = df.checkpoint()._jdf
    plain = DataFrame(session._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), session)
    del df
    gc.collect()
    context._jvm.System.gc()
    return plain


def released() -> None:
    """Give freed memory back to the system. Python workers stay for later tasks and would keep it, beside the memory
    that the executor and its other workers need."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; ``fn`` yields the output batches of one input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        released()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes, so that work arrays stay small; rows stay whole."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values for a seed."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
