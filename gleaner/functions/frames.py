"""Small helpers for DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a side may have before it is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 50_000
#: Bytes of text that a Python worker turns into Python objects at once.
PIECE_BYTES = 1 << 20
#: Bytes of a batch that is sent to a Python worker.
BATCH_BYTES = 4 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a
    local session may name none; it takes its warehouse."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written once into the shared folder and reread: what several branches
    of a plan read is worked out once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    for found in _OPEN:
        found.made.append(out)
    return out


class Scratch:
    """Staged tables written while it is open; release() deletes those that
    nothing will read any more."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def release(self, *kept: DataFrame) -> None:
        paths = {df.stage_path for df in kept}
        discard(*(df for df in self.made if df.stage_path not in paths))
        self.made = list(kept)


_OPEN: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """For who reads a result inside and then releases what it was read from:
    with scratch() as made: rows = engine.ask(q).answers.collect(); made.release()"""
    found = Scratch()
    _OPEN.append(found)
    try:
        yield found
    finally:
        _OPEN.remove(found)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in too few pieces for them (a file of one
    row group); what has enough pieces isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def batched(df: DataFrame) -> DataFrame:
    """df, for a step in Python: its session sends workers batches of at most
    BATCH_BYTES (or what it asks for, if that is less). Spark's own limit is
    64 MB, or 10,000 rows, which the JVM holds in buffers that double as they
    fill and the worker holds whole, for each task."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def filled(batches: Iterable[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, of so many rows or more, for a step that
    gives rows for each batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[slice]:
    """Runs of neighbouring rows of at most size bytes of text, or of one row. A
    batch has 10,000 rows, whatever their texts: as terms in Python lists that is
    a gigabyte for each worker, as one piece after the other some ten megabytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        held = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, held + size, side="right")))
        yield slice(start, end)
        start = end


def top(df: DataFrame, k: int, score: str, by: tuple[str, ...] = ("query_id",), tie: str = "chunk_id", rank: str | None = None) -> DataFrame:
    """The k best rows of each group, ties by id. The planner limits each task to
    k rows of a group before anything is shuffled."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie)))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)
