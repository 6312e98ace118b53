"""BM25 over an inverted index, many queries at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.frames import BROADCAST_ROWS, batched, pieces, small, staged, top
from gleaner.functions.unicode import terms, terms_of

K1, B, SCALE = 1.4, 0.75, 6


def blended(subject: str, chapter: str, title: str, path: str, content: str):
    """B1: the searchable text of a chunk: its non-empty parts."""
    heading = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(title)).otherwise(F.col(path))
    parts = [F.col(subject), F.col(chapter), heading, F.col(content)]
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), " ")


@dataclass
class Index:
    """postings (chunk_id, length, term, tf) and totals, one row (n_docs,
    mean_length over all chunks); both may be tables."""

    postings: DataFrame
    totals: DataFrame

    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def posted(chunks: DataFrame, text, id_column: str = "chunk_id", only: set[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, chunk_id, length, term, tf): a chunk's terms are counted where it
    is, without a shuffle. Each chunk has one more row without a term, which
    stands for the chunk itself. only: terms to restrict the postings to."""
    names = [*keep, "chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole[at] for whole in batches for at in pieces(whole.column("text"))):
            found = [terms_of(x or "") for x in batch.column("text").to_pylist()]
            counts = [Counter(t for t in own if t in only) if only is not None else Counter(own) for own in found]
            lengths, sizes = (np.fromiter(map(len, x), np.int64, len(found)) for x in (found, counts))
            rows = np.repeat(np.arange(len(found)), sizes + 1)
            terms = [t for c in counts for t in (None, *c)]
            times = [n for c in counts for n in (1, *c.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in names), pa.array(lengths[rows]), pa.array(terms, pa.string()), pa.array(times, pa.int64())], [*names, "length", "term", "tf"])

    rows = chunks.select(*keep, F.col(id_column).alias("chunk_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return batched(rows).mapInArrow(run, f"{kinds}, length long, term string, tf long")


def totals(rows: DataFrame) -> DataFrame:
    """The one row of totals of posted rows."""
    return rows.filter("term IS NULL").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))


def build(chunks: DataFrame, text, only: DataFrame | None = None, stage: bool = True) -> Index:
    """The index of chunks; only: terms (a column) to restrict the postings to,
    for a batch of queries without a stored index. stage: write it once, for
    plans that read it in several places."""
    asked = None if only is None else {r.term for r in only.select("term").distinct().take(BROADCAST_ROWS + 1)}
    many = asked is not None and len(asked) > BROADCAST_ROWS
    rows = posted(chunks, text, only=None if many else asked)
    if many:
        rows = rows.filter("term IS NULL").unionByName(rows.join(only.select("term").distinct(), "term", "left_semi"))
    if stage:
        rows = staged(rows, "postings")
    return Index(rows.filter("term IS NOT NULL"), totals(rows))


def query_terms(queries: DataFrame, text: str = "text", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, term, qtf)"""
    return queries.select(*by, F.explode(terms(text)).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("qtf"))


def variants(queries: DataFrame, text: str = "text") -> DataFrame:
    return queries.select("query_id", F.posexplode(T.query_variants(text)).alias("variant", "text"))


def score(asked: DataFrame, index: Index, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, chunk_id, score) of all chunks that share a term. asked (by,
    term, qtf) is a batch of queries, read several times."""
    wanted = asked.select("term").distinct()
    bounded = len(wanted.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    wanted = F.broadcast(wanted) if bounded else wanted
    frequencies = index.frequencies().join(wanted, "term")
    hits = index.postings.join(small(asked), "term").join(F.broadcast(frequencies) if bounded else frequencies, "term")
    found = hits.crossJoin(F.broadcast(index.totals))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("mean_length", F.lit(1e-6))), F.lit(1e-6))
    return found.groupBy(*by, "chunk_id").agg(F.round(F.sum(F.col("qtf") * idf * weight), SCALE).alias("score")).filter("score > 0")


def search(asked: DataFrame, index: Index, k: int = 48) -> DataFrame:
    """(query_id, chunk_id, score) for query terms (query_id, term, qtf) or,
    with a column variant, the best over a query's variants."""
    if "variant" not in asked.columns:
        return top(score(asked, index), k, "score")
    best = score(asked, index, ("query_id", "variant")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top(best, k, "score")
