"""Confidence, the clarification gate, the evidence budget and rendering.

Contexts are (query_id, chunk_id, final_score, ...), a handful for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.frames import small
from gleaner.functions.unicode import terms, three_places

LOW_CONFIDENCE, LOW_MARGIN, LOW_GAP, LOW_RERANK, SCALE = 0.46, 0.06, 0.04, 0.34, 9


@dataclass(frozen=True)
class Limits:
    """Below which an answer is uncertain: confidence, margin, gap, rerank score."""

    confidence: float = LOW_CONFIDENCE
    margin: float = LOW_MARGIN
    gap: float = LOW_GAP
    rerank: float = LOW_RERANK


def gate(contexts: DataFrame, questions: DataFrame, use_reranker: bool = True, limits: Limits = Limits()) -> DataFrame:
    """(query_id, confidence, needs_clarification) for every question.
    The two medians differ as specified: the middle of the five best counted
    upwards for confidence, downwards for the margin."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")
    rows = contexts.withColumns({"r": F.row_number().over(order), "n": F.least(F.count(F.lit(1)).over(Window.partitionBy("query_id")), F.lit(5))})
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("final_score")))
    facts = rows.groupBy("query_id").agg(
        at(1).alias("top1"), at(2).alias("top2"),
        at(F.col("n") - F.floor(F.col("n") / 2)).alias("upward"), at(F.floor(F.col("n") / 2) + 1).alias("downward"),
        F.max("rerank_score").alias("rerank"),
    )
    positive = lambda c: F.greatest(F.lit(0.0), c)
    gap = F.when(F.col("top2").isNull(), F.col("top1")).otherwise(positive(F.col("top1") - F.col("top2")))
    sure = 0.55 * F.col("top1") + 0.25 * F.least(F.lit(1.0), 1.8 * positive(F.col("top1") - F.col("upward"))) + 0.20 * F.least(F.lit(1.0), 2.2 * gap)
    sure = F.round(F.least(F.lit(1.0), positive(sure)), SCALE)
    margin, second = positive(F.col("top1") - F.col("downward")), positive(F.col("top1") - F.coalesce("top2", F.lit(0.0)))
    unsure = (sure < limits.confidence) | (F.round(margin, SCALE) < limits.margin) | (F.round(second, SCALE) < limits.gap)
    if use_reranker:
        unsure |= F.col("rerank") < limits.rerank
    found = facts.select("query_id", sure.alias("confidence"), unsure.alias("unsure"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("unsure", F.lit(True)).alias("needs_clarification"))


def budget(contexts: DataFrame, tokens: Column, chunks: tuple[int, int] = (6, 10), limits: tuple[int, int] = (1500, 3000)) -> DataFrame:
    """the best contexts up to the first that would pass the token limit
    once both minima are met; adds place and tokens."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")
    rows = contexts.withColumns({"tokens": tokens, "place": F.row_number().over(order)})
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stop = (F.col("place") > chunks[0]) & (before + F.col("tokens") > limits[1]) & (before >= limits[0])
    rows = rows.withColumn("_stop", stop.cast("int"))
    return rows.withColumn("_stop", F.max("_stop").over(order)).filter((F.col("_stop") == 0) & (F.col("place") <= chunks[1])).drop("_stop")


def location() -> Column:
    """The page of a context's parent, else its own."""
    return F.coalesce(F.nullif(F.col("parent_page_number"), F.lit(0)), F.col("page_number"))


def evidence(contexts: DataFrame, questions: DataFrame, least: int = 15, most: int = 40) -> DataFrame:
    """(query_id, rank, score, citation): the sentences of the contexts
    (with place, source_name, pages) that answer the question best."""
    asked = questions.select("query_id", F.array_distinct(terms("text")).alias("query_terms"))
    source = blank("parent_content", F.col("content"))
    each = contexts.select("query_id", "place", "final_score", "source_name", location().alias("page"), F.posexplode(T.sentences(source)).alias("pos", "sentence")).filter(F.length("sentence") >= 20)
    each = each.withColumn("own_terms", F.array_distinct(terms("sentence"))).join(small(asked), "query_id")
    points = F.round(0.60 * F.col("final_score") + 0.40 * T.lexical_overlap(F.col("query_terms"), F.col("own_terms")), SCALE)
    cited = F.concat("sentence", F.lit(" [Nguon "), F.col("place").cast("string"), F.lit(": "), "source_name", F.lit(", trang "), F.col("page").cast("string"), F.lit("]"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place", "pos")
    rows = each.select("query_id", points.alias("score"), cited.alias("citation"), "place", "pos").withColumn("rank", F.row_number().over(order))
    return rows.filter(F.col("rank") <= max(least, most)).select("query_id", "rank", "score", "citation")


def clipped(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def in_order(place: str, text: Column, between: str) -> Column:
    """Aggregate: texts of a group joined by place."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), text.alias("t")))), lambda x: x["t"]), between)


def blank(c: str, other: Column) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)


def context_block() -> Column:
    """a context as lines of a prompt."""
    label = F.when(F.lower(T.strip(F.coalesce("doc_type", F.lit("document")))) == "slide", "Slide").otherwise("Trang")
    points = F.concat_ws(" / ", *[three_places(f"{c}_score") for c in ("dense", "sparse", "rrf", "rerank")])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Nguon "), F.col("place").cast("string"), F.lit("]")),
        F.concat(F.lit("File: "), "source_name"),
        F.concat(F.lit("Tieu de: "), blank("title", F.col("source_name"))),
        F.concat(F.lit("Mon/Lop/Chuong: "), F.concat_ws(" / ", blank("subject", F.lit("-")), blank("grade", F.lit("-")), blank("chapter", F.lit("-")))),
        F.concat(label, F.lit(": "), location().cast("string")),
        F.concat(F.lit("Section: "), blank("section_path", blank("parent_title", F.lit("N/A")))),
        F.concat(F.lit("Diem Dense/Sparse/RRF/Rerank: "), points),
        F.concat(F.lit("Doan child: "), clipped(T.strip("content"), 420)),
        F.concat(F.lit("Noi dung parent: "), clipped(T.strip(blank("parent_content", F.col("content"))), 950)),
    )


def rendered(contexts: DataFrame) -> DataFrame:
    """(query_id, context_text)"""
    return contexts.groupBy("query_id").agg(in_order("place", context_block(), "\n\n").alias("context_text"))


def facts(contexts: DataFrame) -> DataFrame:
    """(query_id, facts_text, sources_text) without any model."""
    line = F.concat(F.lit("- "), T.trim_summary(blank("parent_content", F.col("content")), 240), F.lit(" [Nguon "), F.col("place").cast("string"), F.lit("]"))
    source = F.concat(F.lit("- [Nguon "), F.col("place").cast("string"), F.lit("] "), "source_name", F.lit(" (trang "), location().cast("string"), F.lit(")"))
    tail = ["CONFLICTS:", "- Chua xac dinh mau thuan tu local fallback.", "MISSING:", "- Co the thieu du lieu neu can lap luan sau hon."]
    return contexts.groupBy("query_id").agg(
        F.concat_ws("\n", F.lit("FACTS:"), in_order("place", line, "\n"), *map(F.lit, tail)).alias("facts_text"),
        in_order("place", source, "\n").alias("sources_text"),
    )


#: The fields of a context as clients get it, in order.
FIELDS = [
    "source_name", "source_path", "page_number", "location_number", "location_label", "chunk_index", "content", "child_content", "parent_title", "section_path", "title", "subject", "grade",
    "chapter", "published_year", "source", "file_type", "doc_type", "similarity", "lexical_score", "dense_score", "sparse_score", "rrf_score", "rerank_score", "final_score",
]


#: Columns of a chunk that rendering and results need.
NEEDED = ("content", "source_name", "source_path", "file_type", "doc_type", "page_number", "parent_page_number", "chunk_index", "title", "subject", "grade", "chapter", "published_year", "source", "parent_title", "section_path", "parent_content")


def result() -> Column:
    """F16: a context as a struct of FIELDS."""
    label = F.when(F.lower(T.strip(F.coalesce("doc_type", F.lit("")))) == "slide", "slide").otherwise("page")
    made = {"location_number": location(), "location_label": label, "content": blank("parent_content", F.col("content")), "child_content": F.col("content"), "similarity": F.col("dense_score")}
    return F.struct(*[made.get(name, F.col(name)).alias(name) for name in FIELDS])


def serialised() -> Column:
    """F16: a context as JSON for a client."""
    return F.to_json(result(), {"ignoreNullFields": "false"})
