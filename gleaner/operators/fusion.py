"""Fusion of ranked lists, reranking and diversification.

Hits are (query_id, chunk_id, score). All windows are partitioned by query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.frames import BROADCAST_ROWS, batched, top
from gleaner.functions.unicode import terms

RRF_K, FUSED, MIN_SIMILARITY, MIN_LEXICAL, SCALE = 60, 96, 0.30, 0.03, 9


def ranked(hits: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.row_number().over(order).alias(f"{name}_rank"))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = FUSED) -> DataFrame:
    """F1: (query_id, chunk_id, dense_score, sparse_score, rrf_score, rank). A
    query without sparse hits keeps its dense scores and order."""
    both = ranked(dense, "dense").join(ranked(sparse, "sparse"), ["query_id", "chunk_id"], "full")
    lone = F.max(F.col("sparse_rank").isNotNull()).over(Window.partitionBy("query_id"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = F.when(lone, part("dense_rank") + part("sparse_rank")).otherwise(F.col("dense_score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return top(both.select("query_id", "chunk_id", zero("dense_score"), zero("sparse_score"), F.round(fused, 9).alias("rrf_score")), k, "rrf_score", rank="rank")


def with_maxima(fused: DataFrame) -> DataFrame:
    """scores over their query's maxima, taken before anything is filtered."""
    group = Window.partitionBy("query_id")
    for name in ("dense", "sparse", "rrf"):
        fused = fused.withColumn(f"{name}_norm", F.col(f"{name}_score") / F.greatest(F.max(f"{name}_score").over(group), F.lit(1e-6)))
    return fused


def hydrate(fused: DataFrame, chunks: DataFrame, keep: tuple[str, ...] = ("content",), bounded: bool = False) -> DataFrame:
    """chunk columns for the fused ids only; ids without a chunk go.
    bounded: fused is known to have at most BROADCAST_ROWS rows."""
    return chunks.select("chunk_id", *keep).join(F.broadcast(fused) if bounded else fused, "chunk_id")


def relevant(scored: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """F4"""
    return scored.filter(~((F.col("dense_score") < min_similarity) & (F.col("sparse_score") <= 0) & (F.col("lexical_score") < MIN_LEXICAL)))


def fallback_rerank():
    """F6"""
    return 0.60 * F.col("dense_norm") + 0.30 * F.col("sparse_norm") + 0.10 * F.col("lexical_score")


def rerank_payload(section, title, parent, content):
    """what a pair model reads beside the question"""
    head = T.strip(F.when(F.coalesce(section, F.lit("")) != "", section).otherwise(F.coalesce(title, F.lit(""))))
    parts = [head, F.substring(T.strip(F.coalesce(parent, F.lit(""))), 1, 1800), F.substring(T.strip(F.coalesce(content, F.lit(""))), 1, 500)]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def bounded_scores(scored: DataFrame, by: str = "query_id", raw: str = "raw", out: str = "rerank_score") -> DataFrame:
    """E5: if any score of a batch lies outside 0 to 1, all of it goes through
    the logistic function."""
    group = Window.partitionBy(by)
    outside = (F.min(raw).over(group) < 0) | (F.max(raw).over(group) > 1)
    value = F.when(outside, 1 / (1 + F.exp(-F.col(raw)))).otherwise(F.col(raw))
    return scored.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def final_score():
    """F8"""
    total = 0.42 * F.col("rerank_score") + 0.30 * F.col("rrf_norm") + 0.18 * F.col("dense_norm") + 0.07 * F.col("sparse_norm") + 0.03 * F.col("lexical_score")
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), SCALE)


def score(fused: DataFrame, chunks: DataFrame, questions: DataFrame, keep: tuple[str, ...] = ("content", "parent_key"), content: str = "content", min_similarity: float = MIN_SIMILARITY, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """F2 to F8. rerank: a pair model as a function of the columns question and
    payload (embed.pair_scores); without one, the fallback. Its payload is made
    of the columns section_path, parent_title, parent_content and content."""
    asked = questions.select("query_id", F.array_distinct(terms("text")).alias("query_terms"), F.col("text").alias("question"))
    few = len(questions.select(F.lit(1)).take(BROADCAST_ROWS // FUSED + 1)) <= BROADCAST_ROWS // FUSED
    hits = with_maxima(fused)
    # one row for each chunk, so that its text is read and cut into terms once
    packed = hits.groupBy("chunk_id").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "chunk_id"])).alias("hits"))
    rows = hydrate(packed, batched(chunks), keep, few).withColumn("own_terms", F.array_distinct(terms(content)))
    rows = rows.select("chunk_id", *keep, "own_terms", F.inline("hits")).join(F.broadcast(asked) if few else asked, "query_id")
    rows = relevant(rows.withColumn("lexical_score", T.lexical_overlap(F.col("query_terms"), F.col("own_terms"))).drop("query_terms", "own_terms"), min_similarity)
    if rerank is None:
        rows = rows.withColumn("rerank_score", fallback_rerank())
    else:
        payload = rerank_payload(F.col("section_path"), F.col("parent_title"), F.col("parent_content"), F.col("content"))
        rows = bounded_scores(rows.withColumn("raw", rerank(F.col("question"), payload))).drop("raw")
    return rows.drop("question").withColumn("final_score", final_score())


def unique_parents(scored: DataFrame, k: int = 10) -> DataFrame:
    """each parent's best chunk first, then the rest, k in all; adds place."""
    best = Window.partitionBy("query_id", "parent_key").orderBy(F.desc("final_score"), "chunk_id")
    later = F.row_number().over(best) > 1
    order = Window.partitionBy("query_id").orderBy("_later", F.desc("final_score"), "chunk_id")
    return scored.withColumn("_later", later).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("_later")
