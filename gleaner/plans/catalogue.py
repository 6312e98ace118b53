"""The engine's operators as queries over the test tables.

A document row stands for a chunk, its source for the parent, its language for
the subject; benchmark rows are the questions, embeddings their vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.functions import text as T
from gleaner.functions import unicode
from gleaner.functions.frames import small, spread, staged
from gleaner.operators import chunking, dense, embed, evidence, fusion, relational, sections, sparse
from gleaner.plans import prompts
from gleaner.sources import files


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"))

    @property
    def chunks(self) -> DataFrame:
        name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.documents.select(
            F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("lang").alias("subject"), F.lit("").alias("grade"), F.lit("").alias("chapter"),
            F.col("source").alias("parent_key"), F.col("source").alias("parent_title"), F.lit("").alias("section_path"), F.lit("").alias("title"), F.lit("").alias("parent_content"), F.lit("note").alias("doc_type"), F.lit(1).alias("page_number"), name.alias("source_name"),
            F.concat(F.lit("/"), name).alias("source_path"), F.lit(0).alias("chunk_index"), F.lit("").alias("published_year"), F.col("source"), F.lit(".txt").alias("file_type"), F.lit(None).cast("int").alias("parent_page_number"),
        )

    @property
    def questions(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))

    @property
    def asked_vectors(self) -> DataFrame:
        """The stated query set of vector searches."""
        return self.vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")

    def index(self, only: DataFrame | None = None, stage: bool = False) -> sparse.Index:
        return sparse.build(self.chunks, sparse.blended("subject", "chapter", "parent_title", "section_path", "content"), only, stage)

    def sparse_hits(self, with_variants: bool = False) -> DataFrame:
        asked = sparse.query_terms(sparse.variants(self.questions), by=("query_id", "variant")) if with_variants else sparse.query_terms(self.questions)
        asked = staged(asked, "asked")
        return sparse.search(asked, self.index(asked, stage=True), 48)

    def dense_hits(self) -> DataFrame:
        vectors = self.vectors.join(small(self.questions.select(F.col("query_id").alias("chunk_id"))), "chunk_id", "left_semi")
        return dense.exact(vectors.withColumnRenamed("chunk_id", "query_id"), self.vectors, 48)

    def fused(self) -> DataFrame:
        return staged(fusion.rrf(self.dense_hits(), self.sparse_hits()), "fused")

    def scored(self) -> DataFrame:
        return fusion.score(self.fused(), self.chunks, self.questions, ("parent_key", *evidence.NEEDED))

    def contexts(self) -> DataFrame:
        return staged(fusion.unique_parents(self.scored(), 10), "contexts")

    def store(self) -> dict[str, DataFrame]:
        """Stand-ins for the store's tables."""
        documents = self.chunks.select("document_id", "source_name", F.col("source_name").alias("source_path"), "subject", "chapter", "title", F.col("parent_key").alias("source"), F.lit(1).alias("total_pages"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("document_id")).alias("updated_at"))
        parent = F.crc32(F.col("parent_key").cast("binary"))
        parents = self.chunks.groupBy(parent.alias("parent_chunk_id"), "parent_key").agg(F.count(F.lit(1)).alias("n")).select("parent_chunk_id", F.lit(1).alias("page_number"), F.lit(0).alias("parent_index"), F.col("parent_key").alias("title"), F.concat(F.lit("path/"), "parent_key").alias("section_path"), F.concat(F.lit("parent of "), F.col("n").cast("string")).alias("content"))
        mapping = self.chunks.select(F.col("chunk_id").alias("child_chunk_id"), parent.alias("parent_chunk_id"))
        chunks = self.chunks.select("chunk_id", "document_id", "page_number", F.lit(0).alias("chunk_index"), "content")
        return {"documents": documents, "parents": parents, "map": mapping, "chunks": chunks}


def on_documents(**columns):
    """A query that computes columns of each document's text."""
    return lambda t: t.documents.select("doc_id", *[make(F.col("text")).alias(name) for name, make in columns.items()])


def markdown(pages: DataFrame) -> DataFrame:
    """Pages as lines of text: headings, list items, paragraphs."""
    body = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    for pattern, to in MARKS:
        body = F.regexp_replace(body, F.lit(pattern), F.lit(to))
    return pages.select(F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"), body.alias("text"))


MARKS = [("<h1>", "\n# "), ("<h2>", "\n## "), ("<li>", "\n- "), ("<(p|div|article|nav|ul|/h1|/h2|/p|/li|/title)[^>]*>", "\n"), ("<[^>]*>", ""), ("[ \t]*\n[ \t\n]*", "\n")]


def spans(t: Tables) -> DataFrame:
    return t.read("conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def tiers(t: Tables) -> DataFrame:
    return chunking.chunk_single(t.documents.select(F.col("doc_id").alias("document_id"), "text"))


def upserted(t: Tables) -> DataFrame:
    """Each source's documents as successive versions of one path."""
    rows = t.store()["documents"].withColumn("source_path", F.concat("source", F.lit("/"), "subject"))
    old, new = rows.filter("document_id % 2 = 0"), rows.filter("document_id % 2 = 1")
    return relational.upsert(old, new).select("source_path", "document_id", "source_name", "title", "total_pages")


def sigmoid(t: Tables) -> DataFrame:
    raw = t.vectors.select(F.col("chunk_id"), (F.col("chunk_id") % 7).alias("query_id"), F.round(F.get("vector", F.lit(0)).cast("double") * F.when(F.col("chunk_id") % 7 < 3, 1).otherwise(9) + F.when(F.col("chunk_id") % 7 == 1, 0.5).otherwise(0), 6).alias("raw"))
    return fusion.bounded_scores(raw).select("chunk_id", "query_id", F.round("rerank_score", 6).alias("rerank_score"))


def hydrated(t: Tables) -> DataFrame:
    s = t.store()
    wanted = t.vectors.select("chunk_id", (F.lit(100_000_000) - F.col("chunk_id")).alias("ord"))
    rows = relational.hydrate(wanted, s["chunks"], s["documents"], s["map"], s["parents"])
    return rows.select("ord", "chunk_id", "source_name", "subject", "parent_title", "section_path", "parent_content", "parent_page_number")


def cascade(t: Tables) -> DataFrame:
    s = t.store()
    gone = s["documents"].filter("source = 'src3'").select("document_id")
    left = relational.delete(s["chunks"], gone, "document_id")
    maps = relational.delete(s["map"].withColumnRenamed("child_chunk_id", "chunk_id"), s["chunks"].join(gone, "document_id", "left_semi").select("chunk_id"), "chunk_id")
    return left.select("chunk_id").join(maps, "chunk_id", "left").select("chunk_id", F.col("parent_chunk_id").isNotNull().alias("mapped"))


def payloads(t: Tables) -> DataFrame:
    s = t.store()
    docs = s["documents"].withColumn("grade", F.lit("Lop 10"))
    children = t.chunks.select("chunk_id", "document_id", "page_number", F.col("parent_title").alias("title"), "section_path", "content")
    return embed.payload(children, docs).select("chunk_id", "payload")


def results(t: Tables) -> DataFrame:
    """Every field of the JSON that clients get, read back from it."""
    rows = t.contexts().select("query_id", "place", evidence.serialised().alias("j"))
    rounded = {"similarity", "lexical_score", "dense_score", "sparse_score", "rrf_score", "rerank_score", "final_score"}
    read = lambda name: F.get_json_object("j", f"$.{name}")
    return rows.select("query_id", "place", *[F.round(read(n).cast("double"), 6).alias(n) if n in rounded else read(n).alias(n) for n in evidence.FIELDS])


def pick(make, *columns: str):
    return lambda t: make(t).select(*columns)


name_of = lambda t: t.chunks.withColumn("name", F.concat_ws(" ", F.element_at(F.split("content", " "), 1), F.lit("Lop"), (F.col("chunk_id") % 14).cast("string"), F.lit("chuong"), (F.col("chunk_id") % 30).cast("string"), "parent_key", (F.lit(1890) + F.col("chunk_id") % 200).cast("string")))


def metadata(t: Tables) -> DataFrame:
    return name_of(t).select("chunk_id", T.metadata("name", "content").alias("m")).select("chunk_id", "m.*")


def files_of(t: Tables) -> DataFrame:
    """Each document as a file of one of the four kinds of text."""
    kind = F.element_at(F.array(*map(F.lit, files.TEXT)), (F.col("chunk_id") % 4 + 1).cast("int"))
    found = t.chunks.select("source_path", "source_name", kind.alias("file_type"), F.col("content").cast("binary").alias("content"))
    return files.spans(found.filter(F.col("file_type").isin(*files.SUPPORTED))).select("source_path", "file_type", "page_number", "text", F.col("error").isNotNull().alias("failed"))


def blocks(t: Tables) -> DataFrame:
    """Documents after a word that makes some of them questions or answers."""
    head = F.element_at(F.array(*map(F.lit, ("", "Question: ", "DAP AN ", "a list\n- "))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(head, "text")
    return t.documents.select("doc_id", T.is_question(text).alias("question"), T.is_answer(text).alias("answer"), T.is_protected(text).alias("protected"))


def scanned(t: Tables) -> DataFrame:
    """R2: every chunk with its document and parent, by id."""
    s = t.store()
    rows = relational.joined(s["chunks"], s["documents"], s["map"], s["parents"])
    return rows.orderBy("chunk_id").select("chunk_id", "content", "source_name", "subject", "parent_title", "section_path")


def replaced(t: Tables) -> DataFrame:
    """Every third vector is written anew, turned round."""
    new = t.vectors.filter("chunk_id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    rows = relational.uniform_vectors(relational.replaced(t.vectors, new, "chunk_id"), 64)
    return rows.select("chunk_id", F.posexplode("vector").alias("pos", "x")).select("chunk_id", "pos", F.col("x").cast("double").alias("x"))


def told(t: Tables) -> DataFrame:
    """What a prompt tells of each question: the gate, the contexts within the budget, their evidence."""
    contexts = t.contexts()
    chosen = staged(evidence.budget(contexts, T.token_count("content")), "chosen")
    judged = evidence.gate(contexts, t.questions).join(small(t.questions), "query_id").withColumn("intent", T.intent("text"))
    cited = evidence.evidence(chosen, t.questions).groupBy("query_id").agg(evidence.in_order("rank", F.concat(F.lit("- "), "citation"), "\n").alias("citations"))
    return judged.join(evidence.facts(chosen), "query_id", "left").join(evidence.rendered(chosen), "query_id", "left").join(cited, "query_id", "left")


QUERIES = {
    "text_scan": files_of,
    "strip_diacritics": on_documents(out=unicode.strip_diacritics_exact),
    "text_units": lambda t: chunking.unit_rows(t.documents.select(F.col("doc_id").alias("document_id"), T.clean_text("text").alias("text"))),
    "page_units": lambda t: chunking.unit_rows(markdown(spread(t.read("pages"))).select("document_id", T.clean_text("text").alias("text"))),
    "block_kinds": blocks,
    "e5_prefix": on_documents(out=lambda c: T.e5_prefix(c, "intfloat/multilingual-e5-base", "passage")),
    "chunk_scan": scanned,
    "replace_vectors": replaced,
    "vector_scan": lambda t: t.vectors.orderBy("chunk_id").select("chunk_id", F.size("vector").alias("dim")),
    "path_lookup": lambda t: t.store()["documents"].filter(F.col("source_path") == "src3_23.txt").select("document_id"),
    "flat_chunks": lambda t: chunking.flat_rows(t.documents.select(F.col("doc_id").alias("document_id"), "text")),
    "facts_prompt": lambda t: told(t).select("query_id", prompts.facts_prompt().alias("prompt")),
    "answer_prompt": lambda t: told(t).select("query_id", prompts.answer_prompt(F.col("facts_text")).alias("prompt")),
    "local_answer": lambda t: told(t).select("query_id", prompts.local_answer(F.col("facts_text")).alias("answer")),
    "normalize_ws": on_documents(out=T.normalize_whitespace),
    "match_text": on_documents(kept=T.match_text, bare=lambda c: T.match_text(c, False)),
    "ocr_fix": on_documents(out=T.fix_ocr),
    "clean_text": on_documents(out=T.clean_text),
    "abbrev_expand": on_documents(out=T.expand_abbreviations),
    "token_count": on_documents(n=T.token_count),
    "tokens_exploded": lambda t: t.documents.select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "token")),
    "term_freq": lambda t: t.index().postings.select("chunk_id", "term", "tf"),
    "doc_freq": lambda t: t.index().frequencies(),
    "corpus_stats": lambda t: t.index().totals.select("n_docs", F.round("mean_length", 6).alias("mean_length")),
    "sparse_corpus": lambda t: t.chunks.select("chunk_id", F.array_join(unicode.terms(sparse.blended("subject", "chapter", "parent_title", "section_path", "content")), " ").alias("terms")),
    "sentences": lambda t: t.documents.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")),
    "sentence_overlap": on_documents(out=T.sentence_overlap),
    "intent": on_documents(intent=unicode.intents),
    "keywords": on_documents(keywords=unicode.labels),
    "doc_metadata": metadata,
    "doc_type": lambda t: name_of(t).select("chunk_id", T.document_type("name", F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".pptx", ".md"))), (F.col("chunk_id") % 4 + 1).cast("int"))).alias("doc_type")),
    "context_header": lambda t: t.chunks.select("chunk_id", T.context_header(F.col("subject"), F.lit(" Lop 9 "), F.col("chapter"), F.col("parent_key"), F.col("chunk_id") % 3).alias("header")),
    "section_path": lambda t: t.chunks.select("chunk_id", T.section_path(F.upper("parent_key"), F.when(F.col("chunk_id") % 2 == 0, F.col("parent_key")).otherwise(F.col("source_name"))).alias("path")),
    "query_variants": lambda t: t.questions.select("query_id", F.array_join(T.query_variants("text"), "|").alias("variants")),
    "heading_lines": lambda t: sections.lines(markdown(spread(t.read("pages"))), ("document_id",)).select("document_id", "pos", T.is_heading("line").alias("heading")),
    "parent_title": lambda t: t.chunks.select("chunk_id", T.parent_title("content", F.when(F.col("chunk_id") % 2 == 0, F.lit("Section")).otherwise(F.col("source_name"))).alias("title")),
    "trim_summary": on_documents(out=T.trim_summary),
    "sections": lambda t: sections.split(markdown(spread(t.read("pages")))).select("document_id", "section_index", "title", "body"),
    "page_noise": lambda t: sections.without_page_noise(spans(t)),
    "chunks_children": pick(tiers, "document_id", "chunk_index", "parent_index", "content"),
    "chunks_parents": lambda t: tiers(t).select("document_id", "parent_index", "title", "section_path", "keywords", "parent_content").distinct(),
    "embed_payload": payloads,
    "hashed_embedding": lambda t: embed.embed(t.chunks, "content").select("chunk_id", F.posexplode("vector").alias("pos", "x")).select("chunk_id", "pos", F.col("x").cast("double").alias("x")).filter("x <> 0"),
    "l2_normalize": lambda t: t.vectors.select("chunk_id", F.posexplode(dense.normalised(F.transform("vector", lambda x: x.cast("double") * 3))).alias("pos", "x")).select("chunk_id", "pos", F.round("x", 6).alias("x")),
    "dense_topk": lambda t: dense.exact(t.asked_vectors, t.vectors, 48),
    "dense_multi_variant_max": lambda t: dense.merged(dense.exact(t.asked_vectors, t.vectors, 48).withColumn("query_id", F.col("query_id") % 100), 48),
    "lsh_signature": lambda t: dense.signatures(t.vectors, 64).select("chunk_id", "sig"),
    "lsh_topk": lambda t: dense.lsh(t.asked_vectors, dense.signatures(t.vectors, 64), 64),
    "bm25_topk": lambda t: t.sparse_hits(),
    "bm25_multi_variant": lambda t: t.sparse_hits(with_variants=True),
    "rrf_fuse": pick(Tables.fused, "query_id", "chunk_id", "rrf_score", "rank"),
    "rrf_dense_only": lambda t: fusion.rrf(t.dense_hits(), t.dense_hits().limit(0)).select("query_id", "chunk_id", "rrf_score", "rank"),
    "lexical_overlap": pick(Tables.scored, "query_id", "chunk_id", "lexical_score"),
    "relevance_filter": pick(Tables.scored, "query_id", "chunk_id"),
    "rerank_fallback": lambda t: t.scored().select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score")),
    "rerank_payload": lambda t: t.chunks.select("chunk_id", fusion.rerank_payload(F.col("section_path"), F.col("parent_title"), F.col("content"), F.col("content")).alias("payload")),
    "sigmoid_clip": sigmoid,
    "final_score": pick(Tables.scored, "query_id", "chunk_id", "final_score"),
    "unique_parents": pick(Tables.contexts, "query_id", "chunk_id", "place"),
    "confidence": lambda t: evidence.gate(t.contexts(), t.questions).select("query_id", "confidence"),
    "needs_clarification": lambda t: evidence.gate(t.contexts(), t.questions).select("query_id", "needs_clarification"),
    "clarification_text": lambda t: t.documents.select("doc_id", T.clarification(unicode.intents("text")).alias("answer")),
    "evidence_budget": lambda t: evidence.budget(t.contexts(), T.token_count("content")).select("query_id", "chunk_id", "place", "tokens"),
    "evidence_sentences": lambda t: evidence.evidence(evidence.budget(t.contexts(), T.token_count("content")), t.questions),
    "context_blocks": lambda t: evidence.rendered(t.contexts()),
    "local_facts": lambda t: evidence.facts(t.contexts()),
    "result_json": lambda t: results(t),
    "hydrate_join": hydrated,
    "list_documents": lambda t: relational.listing(t.store()["documents"], t.store()["chunks"]).select("document_id", "source_name", "chunk_count"),
    "count_chunks": lambda t: t.store()["chunks"].agg(F.count(F.lit(1)).alias("n")),
    "upsert_latest": upserted,
    "delete_cascade": cascade,
    "dedupe_inputs": lambda t: relational.distinct_paths(t.documents.select(F.concat("source", F.lit("/"), "lang").alias("source_path"))),
    "settings": lambda t: Settings().bounded().table(t.spark),
    "hybrid_retrieve": lambda t: t.contexts().select("query_id", "place", "chunk_id", "dense_score", "sparse_score", "rrf_score", F.round("lexical_score", 6).alias("lexical_score"), "final_score"),
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, make=make: make(Tables(spark, sf_dir))) for name, make in QUERIES.items()}
