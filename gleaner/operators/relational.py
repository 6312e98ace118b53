"""The document store's queries and changes, as DataFrame operations.

Tables: documents (document_id, source_path, ...), chunks (chunk_id,
document_id, page_number, chunk_index, content), parents (parent_chunk_id,
document_id, page_number, parent_index, title, section_path, keywords, content),
map (child_chunk_id, parent_chunk_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.frames import small

DOCUMENT_TEXT = ("title", "subject", "grade", "chapter", "published_year", "source")


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def joined(chunks: DataFrame, documents: DataFrame, mapping: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks with their document and, if there is one, their parent."""
    more = [c for c in ("source_path", "file_type", "doc_type", "grade", "published_year", "source") if c in documents.columns]
    d = documents.select("document_id", "source_name", "subject", "chapter", F.coalesce("title", F.lit("")).alias("title"), *more)
    p = parents.select(
        F.col("parent_chunk_id").alias("_parent"), F.col("page_number").alias("parent_page_number"), "parent_index",
        F.col("title").alias("parent_title"), "section_path", F.col("content").alias("parent_content"),
    )
    rows = chunks.join(d, "document_id").join(mapping, F.col("chunk_id") == F.col("child_chunk_id"), "left").drop("child_chunk_id")
    rows = rows.join(p, F.col("parent_chunk_id") == F.col("_parent"), "left").drop("_parent")
    return rows.withColumns({c: _text(c) for c in ("parent_title", "section_path", "parent_content", "subject", "chapter")})


def hydrate(wanted: DataFrame, chunks: DataFrame, documents: DataFrame, mapping: DataFrame, parents: DataFrame) -> DataFrame:
    """The wanted chunks (chunk_id, ord) with all their columns, by ord"""
    return joined(chunks.join(small(wanted), "chunk_id"), documents, mapping, parents)


def listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, latest first"""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy(F.desc("updated_at"), "document_id")


def upsert(old: DataFrame, new: DataFrame, key: str = "source_path", stamp: str = "updated_at") -> DataFrame:
    """The latest row of each key, with the id of the oldest; defaults: title
    and source are the name, at least one page"""
    rows = old.unionByName(new)
    rows = rows.withColumns({
        "title": F.when(_text("title") == "", F.col("source_name")).otherwise(F.col("title")),
        "source": F.when(_text("source") == "", F.col("source_name")).otherwise(F.col("source")),
        "total_pages": F.greatest(F.lit(1), F.coalesce("total_pages", F.lit(1))),
    })
    latest = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc("document_id"))
    first = F.first("document_id").over(Window.partitionBy(key).orderBy(stamp, "document_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumns({"_first": first, "_rank": F.row_number().over(latest)}).filter("_rank = 1").withColumn("document_id", F.col("_first")).drop("_first", "_rank")


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Table without the rows whose key is in gone; cascade by calling it
    again on the tables that depend on this one"""
    return table.join(small(gone.select(key).distinct()), key, "left_anti")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of those of old with the same key"""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def distinct_paths(paths: DataFrame, path: str = "source_path") -> DataFrame:
    """S12"""
    return paths.filter(F.col(path).isNotNull()).select(path).distinct()


def with_ids(table: DataFrame, name: str, *by: str) -> DataFrame:
    """An id that depends on the row's keys alone"""
    return table.withColumn(name, F.xxhash64(*by))


def uniform_vectors(vectors: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """Fails on a vector of another length when it is read"""
    fault = F.raise_error(F.format_string("a vector has %d numbers, not %d", F.size(column), F.lit(dim)))
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(fault))
