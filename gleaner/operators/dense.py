"""Dense retrieval: exact top-k and hyperplane LSH."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.frames import filled, small, staged, top

SCALE, SEED = 6, 42
#: Query vectors that are sent to every task at once; more are asked in blocks. Scores that a task holds at once.
MOST_QUERIES, MOST_SCORES = 10_000, 4_000_000


def normalised(vector):
    """E3"""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def exact(queries: DataFrame, vectors: DataFrame, k: int = 48) -> DataFrame:
    """(query_id, chunk_id, score) by inner product of unit vectors, over
    every vector. Each batch is multiplied with the queries, MOST_SCORES scores
    at a time, and leaves k rows for each query; the final ranking sees those
    only. Each block of MOST_QUERIES queries reads the vectors once."""
    asked = queries.select("query_id", "vector").toArrow()
    blocks = [_best(asked.slice(at, MOST_QUERIES), vectors, k) for at in range(0, max(1, len(asked)), MOST_QUERIES)]
    return top(reduce(DataFrame.union, blocks), k, "score")


def _best(asked: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    """The k best rows of each batch of vectors for each of these queries."""
    names, matrix = asked.column("query_id").to_numpy(), _matrix(asked.column("vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches):
            if not len(batch) or not len(names):
                continue
            ids, rows = batch.column("chunk_id").to_numpy(), _matrix(batch.column("vector"))
            step = max(1, MOST_SCORES // len(ids))
            for at in range(0, len(names), step):
                found = np.round(np.clip(rows @ matrix[at : at + step].T, -1, 1), SCALE)
                row, column = best_of(found, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(names[at + column]), pa.array(ids[row]), pa.array(found[row, column])], ["query_id", "chunk_id", "score"])

    return vectors.select("chunk_id", "vector").mapInArrow(run, "query_id long, chunk_id long, score double")


def best_of(found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each column, ties by id. Only
    what reaches a column's k-th best score is sorted."""
    least = np.partition(found, len(found) - k, axis=0)[len(found) - k] if len(found) > k else np.full(found.shape[1], -np.inf)
    row, column = np.nonzero(found >= least)
    order = np.lexsort((ids[row], -found[row, column], column))
    row, column = row[order], column[order]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    return row[place < k], column[place < k]


def merged(hits: DataFrame, k: int | None = None) -> DataFrame:
    """The best score of each chunk over a query's variants"""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top(best, k, "score") if k else best


def planes(dim: int, count: int | None = None) -> np.ndarray:
    """D3: unit normals of the hyperplanes"""
    count = max(8, min(24, count or (20 if dim >= 192 else 16)))
    normals = np.random.default_rng(SEED).normal(size=(count, dim)).astype(np.float32)
    return normals / np.maximum(np.linalg.norm(normals, axis=1, keepdims=True), 1e-9)


def signatures(vectors: DataFrame, dim: int, count: int | None = None) -> DataFrame:
    """Adds sig: bit i is set if the projection on plane i isn't negative."""
    normals = planes(dim, count).astype(np.float64)
    weights = 1 << np.arange(len(normals), dtype=np.int64)
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("vector"))
            sig = ((matrix @ normals.T >= 0) * weights).sum(axis=1) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.int64())], [*names, "sig"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, sig long")


def probes(count: int) -> np.ndarray:
    """Masks in order: the own bucket, then one flipped bit, then two."""
    one = [1 << i for i in range(count)]
    two = [1 << i | 1 << j for i in range(count) for j in range(i + 1, count)]
    return np.array([0, *one, *two], np.int64)


def lsh(queries: DataFrame, signed: DataFrame, dim: int, k: int = 48, count: int | None = None, target: int | None = None) -> DataFrame:
    """Buckets are probed in order until they hold `target` vectors (the
    rule's max(6 k, 30) unless another is asked for); if all within two bits hold
    fewer, the nearest 2 target by Hamming distance (then by id) are taken.
    Candidates are ranked by their exact score. Tasks get the sizes of all
    buckets, at most one for each of the 2 ** count signatures."""
    normals = len(planes(dim, count))
    found = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).toArrow()
    sigs, sizes = found.column("sig").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(sigs)
    sigs, sizes = sigs[order], sizes[order]
    target = min(int(sizes.sum()), target or max(6 * k, 30))
    masks = probes(normals)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, sig in zip(batch.column("query_id").to_pylist(), batch.column("sig").to_pylist(), strict=True):
                sought = sig ^ masks
                at = np.minimum(np.searchsorted(sigs, sought), max(0, len(sigs) - 1))
                held = np.where(sigs[at] == sought, sizes[at], 0) if len(sigs) else np.zeros(len(sought), np.int64)
                if held.sum() >= target:
                    rows += [(name, int(s), -1) for s in sought[(np.cumsum(held) - held < target) & (held > 0)]]
                else:
                    far = np.bitwise_count(sigs ^ sig)
                    inner = np.bincount(far, weights=sizes, minlength=normals + 1).cumsum()
                    radius = int(np.searchsorted(inner, 2 * target)) if len(sigs) else 0
                    rows += [(name, int(s), int(d)) for s, d in zip(sigs[far <= radius], far[far <= radius], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["query_id", "sig", "far"])

    asked = signatures(queries.select("query_id", "vector"), dim, count)
    places = staged(asked.mapInArrow(walk, "query_id long, sig long, far int"), "probes")
    near = signed.select("chunk_id", "sig", "vector").join(small(places), "sig").join(small(queries.select("query_id", F.col("vector").alias("q"))), "query_id")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("vector"), F.col("q")))), SCALE)
    scored = near.select("query_id", "chunk_id", "far", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "chunk_id"))
    return top(scored.withColumn("place", place).filter((F.col("far") < 0) | (F.col("place") <= 2 * target)).select("query_id", "chunk_id", "score"), k, "score")
