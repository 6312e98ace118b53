"""Search, fusion, evidence and the engine end to end."""

import numpy as np
import pytest
from gleaner.config import Settings
from gleaner.operators import dense, evidence, fusion, relational
from gleaner.plans.engine import Engine
from gleaner.sources import files
from gleaner.streaming.ingest import watch
from pyspark.sql import functions as F

HITS = "query_id long, chunk_id long, score double"


def hits(spark, found):
    return spark.createDataFrame([(0, c, s) for c, s in found.items()], HITS)


def test_rrf(spark):
    out = fusion.rrf(hits(spark, {1: 0.9, 2: 0.8}), hits(spark, {2: 5.0, 3: 4.0})).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.rrf_score, 6)) for r in out] == [(2, 0.032522), (1, 0.016393), (3, 0.016129)]
    alone = fusion.rrf(hits(spark, {1: 0.9}), hits(spark, {})).collect()
    assert [(r.chunk_id, r.rrf_score) for r in alone] == [(1, 0.9)]


def test_relevance_filter(spark):
    rows = spark.createDataFrame([(1, 0.29, 0.0, 0.02), (2, 0.29, 0.0, 0.03), (3, 0.3, 0.0, 0.0), (4, 0.0, 0.1, 0.0)], "id int, dense_score double, sparse_score double, lexical_score double")
    assert {r.id for r in fusion.relevant(rows).collect()} == {2, 3, 4}


def contexts(spark, scores, parents=None):
    rows = [(0, i, float(s), (parents or "abcdefghijkl")[i - 1], 0.9) for i, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, final_score double, parent_key string, rerank_score double")


@pytest.mark.parametrize(("scores", "confidence", "clarify"), [([0.9, 0.6, 0.5, 0.4], 0.762, False), ([0.8], 0.64, True), ([], 0.0, True)])
def test_gate(spark, scores, confidence, clarify):
    asked = spark.createDataFrame([(0, "?")], "query_id long, text string")
    row = evidence.gate(contexts(spark, scores), asked).first()
    assert (round(row.confidence, 6), row.needs_clarification) == (confidence, clarify)


def test_unique_parents(spark):
    rows = contexts(spark, [0.9, 0.8, 0.7], "PPQ")
    order = lambda k: [r.chunk_id for r in fusion.unique_parents(rows, k).orderBy("place").collect()]
    assert order(2) == [1, 3] and order(3) == [1, 3, 2]


@pytest.mark.parametrize(("tokens", "taken"), [(400, 7), (700, 6), (100, 10)])
def test_budget(spark, tokens, taken):
    rows = contexts(spark, [1 - i / 100 for i in range(12)])
    assert evidence.budget(rows, F.lit(tokens)).count() == taken


def test_pair_scores(spark):
    for raw, want in (([0.2, 0.9], [0.2, 0.9]), ([0.2, 2.0], [0.549834, 0.880797])):
        rows = spark.createDataFrame([(0, x) for x in raw], "query_id long, raw double")
        assert [round(r.rerank_score, 6) for r in fusion.bounded_scores(rows).orderBy("raw").collect()] == want


def test_upsert_defaults(spark):
    schema = "document_id long, source_path string, source_name string, title string, source string, total_pages int, updated_at int"
    old = spark.createDataFrame([(1, "p", "a.txt", "t", "s", 3, 1), (2, "q", "b.txt", "u", "s", 1, 1)], schema)
    new = spark.createDataFrame([(7, "p", "a.txt", "", "", 0, 2)], schema)
    row = relational.upsert(old, new).filter("source_path = 'p'").first()
    assert (row.document_id, row.title, row.source, row.total_pages) == (1, "a.txt", "a.txt", 1)
    with pytest.raises(Exception, match="numbers, not 3"):
        relational.uniform_vectors(spark.createDataFrame([([1.0],)], "vector array<float>"), 3).collect()


def test_store_reads_with_gaps(spark):
    """Documents without chunks, chunks without a parent, a parent that is gone."""
    documents = spark.createDataFrame([(1, "a", "s", "", "t", 1), (2, "b", None, None, None, 2), (3, "c", "", "", "", 3)], "document_id long, source_name string, subject string, chapter string, title string, updated_at int")
    chunks = spark.createDataFrame([(10, 1, 1, 0, "x"), (11, 1, 1, 1, "y"), (20, 2, 1, 0, "z")], "chunk_id long, document_id long, page_number int, chunk_index int, content string")
    mapping = spark.createDataFrame([(10, 100), (20, 999)], "child_chunk_id long, parent_chunk_id long")
    parents = spark.createDataFrame([(100, 4, 0, "head", "path", "whole")], "parent_chunk_id long, page_number int, parent_index int, title string, section_path string, content string")
    listed = relational.listing(documents, chunks).collect()
    assert [(r.document_id, r.chunk_count) for r in listed] == [(3, 0), (2, 1), (1, 2)]
    wanted = spark.createDataFrame([(20, 0), (10, 1), (11, 2), (77, 3)], "chunk_id long, ord int")
    rows = relational.hydrate(wanted, chunks, documents, mapping, parents).orderBy("ord").collect()
    assert [(r.chunk_id, r.parent_title, r.parent_page_number, r.subject) for r in rows] == [(20, "", None, ""), (10, "head", 4, "s"), (11, "", None, "s")]
    gone = documents.filter("document_id = 1").select("document_id")
    left = relational.delete(chunks, gone, "document_id")
    assert {r.chunk_id for r in left.collect()} == {20}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, relational.replaced(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_lsh_is_exact_when_all_are_candidates(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>").repartition(3)
    asked = vectors.filter("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    exact = dense.exact(asked, vectors, 10)
    near = dense.lsh(asked, dense.signatures(vectors, 16), 16, 10)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, near.collect()))
    few = dense.lsh(asked, dense.signatures(vectors, 16), 16, 2)
    assert few.join(vectors, "chunk_id").count() == few.count() == 6
    assert dense.exact(asked.limit(0), vectors, 5).count() == 0


def test_exact_asks_any_number_of_queries_in_blocks(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(dense, "MOST_QUERIES", 7)
    monkeypatch.setattr(dense, "MOST_SCORES", 50)
    asked = vectors.filter("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    scores = np.round(v[:30] @ v.T, dense.SCALE)
    want = {(q, int(c)) for q in range(30) for c in np.lexsort((np.arange(60), -scores[q]))[:5]}
    assert {(r.query_id, r.chunk_id) for r in dense.exact(asked, vectors, 5).collect()} == want


def test_settings():
    s = Settings.from_env({"GLEANER_TOP_K": "0", "GLEANER_USE_HYBRID": "no", "GLEANER_CHILD_MAX": "x", "GLEANER_LOW_MARGIN": "7"})
    assert (s.top_k, s.use_hybrid, s.child_max, s.low_margin, s.wanted) == (1, False, 700, 1.0, 10)


TOPICS = {"graph theory": "A graph has vertices and edges.", "calculus": "An integral measures area under a curve.", "botany": "A leaf makes sugar from light."}


def test_engine(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, fact in TOPICS.items():
        (folder / f"{name}.txt").write_text("\n".join([f"# {name}", *[f"{fact} Note {i} about {name} for readers." for i in range(40)]]))
    (folder / "empty.md").write_text(" \n")
    (folder / "skip.bin").write_bytes(b"\0")
    (folder / "broken.pdf").write_bytes(b"not a pdf")
    engine = Engine(spark, str(tmp_path / "store"))
    status = {r.source_path.rsplit("/", 1)[1]: r.status for r in engine.ingest_folder(str(folder)).collect()}
    assert {k.replace("%20", " "): v for k, v in status.items()} == {**{f"{n}.txt": "ingested" for n in TOPICS}, "empty.md": "skipped", "skip.bin": "skipped", "broken.pdf": "failed"}
    before = {r.source_name: r.chunk_count for r in engine.list_documents().collect()}
    assert before.keys() == {f"{n}.txt" for n in TOPICS}
    engine.ingest_folder(str(folder)).collect()
    assert {r.source_name: r.chunk_count for r in engine.list_documents().collect()} == before
    asked = spark.createDataFrame([(1, "integral area under a curve"), (2, "zzz qqq")], "query_id long, text string")
    result = engine.ask(asked)
    answers = {r.query_id: r for r in result.answers.collect()}
    assert answers.keys() == {1, 2} and answers[2].needs_clarification
    best = result.contexts.filter("query_id = 1").orderBy("place").first()
    assert best.source_name == "calculus.txt" and 0 <= answers[1].confidence <= 1
    (folder / "late.txt").write_text("Late news. " * 50)
    watch(engine, str(folder), str(tmp_path / "progress")).awaitTermination(120)
    assert engine.list_documents().count() == 4
    engine.remove(engine.table("documents").filter("source_name = 'late.txt'").select("source_path"))
    assert engine.list_documents().count() == 3 and engine.table("chunks").count() == sum(before.values())


def test_sources(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("é\xff".encode("latin-1") + b" ok")
    found = files.spans(files.scan(spark, str(tmp_path))).first()
    assert found.text == "ok" and found.file_type == ".txt"
