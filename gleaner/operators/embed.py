"""Embedding of texts. The default needs no model: hashed features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T


#: Features whose digests a worker remembers before it starts anew.
FEATURES_KEPT = 500_000


class Embedder(Protocol):
    """Made once in each worker process; gives one row for each text."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of words and word pairs in hashed places."""

    def __init__(self, dim: int = 256):
        self.dim, self.known = dim, {}

    def code(self, feature: str) -> int:
        """The first four bytes of the feature's digest; remembered, up to a bound."""
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= FEATURES_KEPT:
                self.known.clear()
            found = self.known[feature] = int.from_bytes(md5(feature.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4], "big")
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = text.casefold().split()
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                code = self.code(feature)
                row[code % self.dim] += 1 if code >> 31 else -1
        return out


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder] = HashingEmbedder, keep: tuple[str, ...] = ("chunk_id",), model: str = "", kind: str = "passage", batch: int = 32) -> DataFrame:
    """(keep, vector array<float>), unit length"""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.slice(at, batch)
                found = np.asarray(embedder([x or "" for x in some.column("text").to_pylist()]), np.float32)
                found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(found.ravel().astype(np.float32)))], [*names, "vector"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, T.e5_prefix(text, model, kind).alias("text")).mapInArrow(run, f"{schema}, vector array<float>")


def payload(children: DataFrame, documents: DataFrame) -> DataFrame:
    """C17: what is embedded: a context header above the child's text"""
    rows = children.join(documents.select("document_id", "subject", "grade", "chapter"), "document_id")
    section = F.when(F.coalesce("section_path", F.lit("")) != "", F.col("section_path")).otherwise(F.coalesce("title", F.lit("")))
    head = T.context_header(F.col("subject"), F.col("grade"), F.col("chapter"), section, F.col("page_number"))
    return rows.withColumn("payload", F.when(head == "", F.col("content")).otherwise(F.concat_ws("\n", head, "content")))


class PairModel(Protocol):
    """Made once in each worker process; raw scores of (question, payload) pairs."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def pair_scores(make: Callable[[], PairModel]):
    """E5's model as a column function of (question, payload); scores are raw."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for questions, payloads in batches:
            yield pd.Series(score(list(zip(questions, payloads, strict=True))), dtype="float64")

    return run
