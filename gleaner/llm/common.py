"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import frames
from gleaner.functions.frames import BROADCAST_ROWS, batched, discard, scratch, small, staged

__all__ = ["BROADCAST_ROWS", "batched", "discard", "scratch", "small"]

#: Rows of one key that a task of a join may meet before the key is dealt over several.
HOT_ROWS = 256

#: The white space that separates words: U+0020 and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once into the shared folder and rereads it: cuts lineage and
    survives lost executors."""
    return staged(df, f"stage-{tag}")


def meet(rows: DataFrame, table: DataFrame, key: str, deal: Column, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to table on key. table has one row for each key and in size
    (which goes) how many rows may have it, total being at least their sum. The
    rows of a key of more than HOT_ROWS are dealt over several tasks by the
    number `deal`, each with a copy of the key's row. There are at most
    BROADCAST_ROWS such keys, as their size rises with the total."""
    most = max(HOT_ROWS, total // BROADCAST_ROWS)
    ways = F.ceil(F.col("size") / most).cast("int")
    hot = table.filter(F.col("size") > most).select(F.col(key).alias("_hot"), ways.alias("_ways"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_way", F.coalesce(F.pmod(deal, F.col("_ways")), F.lit(0)).cast("int")).drop("_hot", "_ways")
    shown = table.withColumn("_way", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), ways) - 1))).drop("size")
    return dealt.join(shown, [key, "_way"], how).drop("_way")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids fall in fold -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def give_back() -> None:
    """Returns to the system what Arrow's and the C library's allocators keep of
    freed memory. Workers outlive a stage of a plan: what one stage leaves in
    them stands beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


#: What a worker process keeps beyond a task, by name.
_RESIDENT: dict[str, object] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """What make gives, made once in each worker process until vacate()."""
    if name not in _RESIDENT:
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def vacate() -> None:
    """For a step that keeps nothing itself: lets go of what the steps before it
    left in this worker process."""
    if _RESIDENT:
        _RESIDENT.clear()
        give_back()


def by_piece(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1_000_000) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """(texts, null as empty; their rows) of each batch, in runs of at most size
    bytes of text or of one row. Only one run is held as Python objects."""
    for batch in batches:
        for at in frames.pieces(batch.column(column), size):
            part = batch[at]
            yield texts_of(part, column), part
        give_back()


def list_array(parts: list, kind: pa.DataType, dtype: type) -> pa.ListArray:
    """An Arrow list column from one sequence of numbers for each row."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate([np.asarray(p, dtype) for p in parts]) if len(parts) else np.empty(0, dtype)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype, copy=False), kind))
