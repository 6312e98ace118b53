"""Ingestion and question answering over the tables of a store.

Documents become pages, chunks, vectors with their signatures, and postings, all
stored at ingestion. Questions are answered in batches: each step is one plan
for all of them. What several steps read is staged in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import MappingProxyType
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import text as T
from gleaner.functions.frames import discard, small, staged
from gleaner.operators import chunking, dense, embed, evidence, fusion, relational, sparse
from gleaner.plans import prompts
from gleaner.sources import files
from gleaner.sources.store import Store

#: Distinct terms of a batch of questions up to which the postings' files are asked for them by name.
NAMED_TERMS = 1000


class AnswerModel(Protocol):
    """writes a text from a prompt; empty text falls back to local facts.
    Made once in each worker process."""

    def __call__(self, prompt: str) -> str: ...


def chain(*models: Callable[[], AnswerModel]) -> Callable[[], AnswerModel]:
    """asks models in turn until one says something; one that fails is silent."""

    def make() -> AnswerModel:
        made = [model() for model in models]

        def ask(prompt: str) -> str:
            for model in made:
                try:
                    said = model(prompt)
                except Exception:  # an unreachable model must not end the batch
                    continue
                if said:
                    return said
            return ""

        return ask

    return make


@dataclass
class Answers:
    """One row for each question, and the contexts used."""

    answers: DataFrame
    contexts: DataFrame


class Engine:
    """embedder, reranker: made once in each worker process; the reranker gives
    raw scores of (question, payload) pairs. parsers: see files.spans."""

    def __init__(self, spark: SparkSession, store: str, settings: Settings | None = None, embedder: Callable[[], embed.Embedder] = embed.HashingEmbedder, reranker: Callable[[], embed.PairModel] | None = None, parsers: files.Parsers = MappingProxyType({})):
        self.spark, self.store = spark, Store(spark, store)
        self.settings = (settings or Settings()).bounded()
        self.embedder, self.reranker, self.parsers = embedder, reranker, parsers

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def ingest_folder(self, *paths: str, recursive: bool = True) -> DataFrame:
        """A path that isn't there is a row of its own, not an error."""
        found, missing = files.existing(self.spark, paths)
        lost = self.spark.createDataFrame([(p, "failed", 0, f"Folder does not exist: {p}") for p in missing], "source_path string, status string, chunks long, error string")
        return self.ingest(files.scan(self.spark, *found, recursive=recursive)).union(lost) if found else lost

    def ingest(self, found: DataFrame) -> DataFrame:
        """Chunks, embeds, indexes and stores files (source_path, source_name,
        file_type, content); a document that was there is replaced. Returns one
        row for each file: ingested, skipped or failed. All tables change at
        once, when the batch is committed."""
        s = self.settings
        known = F.col("file_type").isin(*files.SUPPORTED, *self.parsers)
        spans = staged(files.spans(found.filter(known), self.parsers).withColumn("document_id", F.xxhash64("source_path")), "spans")
        good = spans.filter("error IS NULL AND text <> ''")
        head = good.groupBy("document_id").agg(F.first("source_path").alias("source_path"), F.first("source_name").alias("source_name"), F.first("file_type").alias("file_type"), F.min_by("text", "page_number").alias("text"), F.max("page_number").alias("total_pages"))
        documents = head.select("document_id", "source_path", "source_name", "file_type", T.document_type("source_name", "file_type").alias("doc_type"), "total_pages", T.metadata("source_name", "text").alias("m"), F.current_timestamp().alias("updated_at")).select("*", "m.*").drop("m")
        documents = staged(documents, "documents")
        tiers = staged(chunking.chunk(good.join(small(documents.select("document_id", "chapter")), "document_id"), s.sizes, "chapter"), "tiers")
        parents = tiers.select("document_id", "page_number", "parent_index", "title", "section_path", "keywords", F.col("parent_content").alias("content")).distinct()
        parents = relational.with_ids(parents, "parent_chunk_id", "document_id", "parent_index")
        children = relational.with_ids(tiers, "chunk_id", "document_id", "chunk_index")
        mapping = children.select("document_id", F.col("chunk_id").alias("child_chunk_id"), F.xxhash64("document_id", "parent_index").alias("parent_chunk_id"))
        dim = self.embedder().dim
        vectors = embed.embed(embed.payload(children, documents), "payload", self.embedder, ("chunk_id", "document_id"), s.embedding_model)
        vectors = dense.signatures(relational.uniform_vectors(vectors, dim), dim)
        searched = children.select("document_id", "chunk_id", F.col("title").alias("parent_title"), "section_path", "content").join(small(documents.select("document_id", "subject", "chapter")), "document_id")
        postings = sparse.posted(searched, sparse.blended("subject", "chapter", "parent_title", "section_path", "content"), keep=("document_id",))
        self.store.commit({"documents": documents, "chunks": children, "parents": parents, "map": mapping, "embeddings": vectors, "postings": postings}, documents)

        count = tiers.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
        outcome = spans.groupBy("document_id", "source_path").agg(F.first("error", ignorenulls=True).alias("error")).join(count, "document_id", "left")
        outcome = outcome.select("source_path", F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("chunks", F.lit(0)) > 0, "ingested").otherwise("skipped").alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "error")
        other = found.filter(~known).select("source_path", F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"))
        result = staged(outcome.union(other), "outcome")
        discard(spans, documents, tiers)
        return result

    def remove(self, paths: DataFrame) -> None:
        """Deletes documents (source_path) with all that belongs to them."""
        gone = self.table("documents").join(small(paths.select("source_path").distinct()), "source_path", "left_semi").select("document_id")
        self.store.commit({}, gone)

    def list_documents(self) -> DataFrame:
        return relational.listing(self.table("documents"), self.table("chunks"))

    def index(self, asked: DataFrame) -> sparse.Index:
        """The stored index for a batch of query terms."""
        rows, wanted = self.table("postings"), asked.select("term").distinct()
        named = [r.term for r in wanted.take(NAMED_TERMS + 1)]
        some = rows.filter(F.col("term").isin(named)) if len(named) <= NAMED_TERMS else rows.join(small(wanted), "term", "left_semi")
        return sparse.Index(some.drop("document_id"), sparse.totals(rows))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Contexts (query_id, chunk_id, place, scores, chunk columns) of
        questions (query_id, text)."""
        s = self.settings
        wordings = staged(sparse.variants(questions).withColumn("vid", F.xxhash64("query_id", "variant")), "wordings")
        vectors = embed.embed(wordings, "text", self.embedder, ("query_id", "vid"), s.embedding_model, "query").select(F.col("vid").alias("query_id"), "vector")
        stored, k = self.table("embeddings").select("chunk_id", "vector", "sig"), max(s.top_k_dense, s.ann_candidates)
        hits = dense.lsh(vectors, stored, self.embedder().dim, k) if s.use_lsh else dense.exact(vectors, stored, k)
        near = dense.merged(hits.withColumnRenamed("query_id", "vid").join(small(wordings.select("vid", "query_id")), "vid"))
        if s.use_hybrid:
            asked = staged(sparse.query_terms(wordings, by=("query_id", "variant")), "asked")
            found = sparse.search(asked, self.index(asked), s.top_k_sparse)
        else:
            found = near.limit(0)
        fused = staged(fusion.rrf(near, found, s.fusion_top_k), "fused")
        chunks = self.table("chunks").join(small(fused.select("chunk_id").distinct()), "chunk_id", "left_semi")
        rows = relational.joined(chunks, self.table("documents"), self.table("map").select("child_chunk_id", "parent_chunk_id"), self.table("parents").drop("document_id", "keywords"))
        rows = rows.withColumn("parent_key", F.coalesce(F.concat(F.lit("p"), F.col("parent_chunk_id").cast("string")), F.concat(F.lit("c"), F.col("chunk_id").cast("string"))))
        pairs = embed.pair_scores(self.reranker) if self.reranker and s.use_reranker else None
        scored = fusion.score(fused, rows, questions, ("parent_key", *evidence.NEEDED), min_similarity=s.min_similarity, rerank=pairs)
        return fusion.unique_parents(scored, s.wanted)

    def ask(self, questions: DataFrame, model: Callable[[], AnswerModel] | None = None) -> Answers:
        """Answers (query_id, intent, confidence, needs_clarification, provider,
        answer) of questions (query_id, text). A model is made in each worker and
        asked twice for each question that passes the gate. Contexts are those
        within the budget, or all where the question needs to be clearer."""
        s = self.settings
        found = staged(self.retrieve(questions), "contexts")
        limits = evidence.Limits(s.low_confidence, s.low_margin, s.low_gap, s.rerank_low)
        judged = evidence.gate(found, questions, s.use_reranker, limits).join(questions, "query_id").withColumn("intent", T.intent("text"))
        judged = staged(judged, "judged")
        clear = found.join(small(judged.filter("NOT needs_clarification").select("query_id")), "query_id", "left_semi")
        chosen = staged(evidence.budget(clear, T.token_count(F.when(F.col("content") != "", F.col("content")).otherwise(F.col("parent_content"))), (s.evidence_chunk_min, s.evidence_chunk_max), (s.evidence_min_tokens, s.evidence_max_tokens)), "chosen")
        out = judged.join(evidence.facts(chosen), "query_id", "left").join(evidence.rendered(chosen), "query_id", "left")
        if s.compress_evidence:
            cited = evidence.evidence(chosen, questions, s.evidence_sentence_min, s.evidence_sentence_max)
            lines = cited.groupBy("query_id").agg(evidence.in_order("rank", F.concat(F.lit("- "), "citation"), "\n").alias("citations"))
            out = out.join(lines, "query_id", "left")
        else:
            out = out.withColumn("citations", F.lit(""))
        if model is None:
            out = out.withColumns({"facts": F.col("facts_text"), "said": F.lit("")})
        else:
            out = written(out, model)
        answer = F.when(F.col("needs_clarification"), T.clarification("intent")).when(F.col("said") != "", F.col("said")).otherwise(prompts.local_answer(F.col("facts")))
        provider = F.when(~F.col("needs_clarification") & (F.col("said") != ""), "model").otherwise("local")
        rest = found.join(small(judged.filter("needs_clarification").select("query_id")), "query_id", "left_semi").withColumn("tokens", F.lit(None).cast("long"))
        return Answers(out.select("query_id", "intent", "confidence", "needs_clarification", provider.alias("provider"), answer.alias("answer")), chosen.unionByName(rest))


def written(rows: DataFrame, model: Callable[[], AnswerModel]) -> DataFrame:
    """two passes for each question that needs no clarification: facts
    from the contexts (without a model's, the local ones), then the answer from
    the facts. Adds facts and said, an empty text where the model gave none."""
    mark = "\x00facts\x00"
    names = rows.columns
    rows = rows.withColumns({"first_prompt": F.when(~F.col("needs_clarification"), prompts.facts_prompt()), "second_prompt": prompts.answer_prompt(F.lit(mark))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            facts, said = [], []
            for first, second, local in zip(*(batch.column(c).to_pylist() for c in ("first_prompt", "second_prompt", "facts_text")), strict=True):
                if first is None:
                    facts.append(local)
                    said.append("")
                    continue
                ask = ask or model()
                facts.append(ask(first) or local or "")
                said.append(ask(second.replace(mark, facts[-1])) or "")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(facts, pa.string()), pa.array(said, pa.string())], [*names, "facts", "said"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(run, f"{kinds}, facts string, said string")
