"""A training corpus in five stages.

Each stage takes what the one before it kept, with the columns of documents, and
its decisions take effect: rules reject, the toxic go, one document of each
group of near duplicates stays, sources are mixed by sampling, and what remains
is encoded (the last stage returns digests of ids and decoded texts).

Null texts and those under 20 words go in the first stage. Every stage judges
rows, not ids: a row is known by a digest of all its columns, so that rows with a
null id or an id that others have too are judged like any other. Of rows that
repeat in every column, near_duplicates leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, jaccard, mixing, quality, toxicity
from gleaner.llm.common import read, scratch, small, stage_table
from gleaner.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores from which a document counts as toxic, and the share of tokens that mixing keeps.
TOXIC, BUDGET = 0.7, 0.8


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a digest of all columns (a null differs from any value)."""
    digest = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-"))
    return docs.select(*COLUMNS, F.unhex(F.md5(F.concat_ws(",", *map(digest, COLUMNS)).cast("binary"))).alias("row_key"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (of keyed) but for those whose row_key is in keys (row_key)."""
    gone = small(stage_table(keys.distinct(), "gone"))
    return rows.join(gone, "row_key", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    judged = quality.judge(rows, read(spark, sf_dir, "labels"), keep=("row_key",))
    return without(rows, judged.filter(~F.col("kept")).select("row_key")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True))
    rows = keyed(docs)
    return without(rows, toxicity.score(rows, network, "row_key").filter(F.col("score") >= TOXIC).select("row_key")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row of the smallest id stays, of a null id only where a class has no other
    rows = keyed(docs)
    placed = rows.withColumn("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    classes = jaccard.join(placed, "row").select("row.row_key", (F.col("class_id.row_key") == F.col("row.row_key")).alias("stays"), "copies")
    classes = stage_table(classes, "verdicts")
    left = without(rows, classes.filter(~F.col("stays")).select("row_key"))
    again = stage_table(classes.filter("stays AND copies > 1").groupBy("row_key").count().filter("count > 1").select("row_key"), "again")
    once = left.join(small(again), "row_key", "left_semi").dropDuplicates(["row_key"])
    return left.join(small(again), "row_key", "left_anti").unionByName(once).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are drawn by their id, but by their key where it is null or others have it too
    rows = keyed(docs)
    shared = small(stage_table(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared_id")), "shared"))
    told = rows.join(shared, F.col("doc_id") == F.col("shared_id"), "left")
    told = told.withColumn("draw_id", F.when(F.col("doc_id").isNull() | F.col("shared_id").isNotNull(), F.hex("row_key")).otherwise(F.col("doc_id").cast("string")))
    mixed = mixing.mix(told, "draw_id", budget=BUDGET, keep=("row_key",))
    return without(rows, mixed.filter(~F.col("sampled")).select("row_key")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The recurrent network and the encoder can't be written in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch() as made:
        for name, stage in STAGES:
            docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.release(docs)  # what the stage wrote on its way, and the table before it
    return docs
