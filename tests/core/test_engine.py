"""The engine over one small store: settings, models, commits, sources."""

import os
from dataclasses import replace

import pytest
from gleaner.config import Settings
from gleaner.functions.frames import scratch
from gleaner.operators import evidence, sections
from gleaner.plans import prompts
from gleaner.plans.engine import Engine, chain
from gleaner.sources import files
from pyspark.sql import functions as F

FACTS = {
    "lop 9 toan chuong 2.txt": "A right triangle has one right angle.",
    "calculus 1999.md": "An integral measures the area under a curve.",
    "botany.log": "A leaf makes sugar from light and water.",
    "slide geology.txt": "Granite cools slowly deep below ground.",
}


def page(fact, n=60):
    return "\n".join([f"# {fact.split()[1]}", *[f"{fact} Remark {i} concerns {fact.split()[1]} number {i}." for i in range(n)]])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    (base / "docs").mkdir()
    for name, fact in FACTS.items():
        (base / "docs" / name).write_text(page(fact))
    status = Engine(spark, str(base / "store")).ingest_folder(str(base / "docs"), str(base / "nowhere")).collect()
    assert sorted((r.status, r.error) for r in status) == sorted([("failed", f"Folder does not exist: {base / 'nowhere'}"), *[("ingested", None)] * 4], key=str)
    return base


@pytest.fixture(scope="module")
def engine(spark, store):
    return lambda reranker=None, **settings: Engine(spark, str(store / "store"), replace(Settings(), **settings), reranker=reranker)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_stored_index_is_that_of_the_chunks(spark, engine):
    e = engine()
    postings = e.table("postings")
    assert postings.filter("term IS NULL").count() == e.table("chunks").count()
    assert e.table("embeddings").filter("sig IS NULL OR size(vector) <> 256").count() == 0
    words = e.index(spark.createDataFrame([("integral",), ("curve",)], "term string"))
    assert {r.term for r in words.postings.select("term").distinct().collect()} == {"integral", "curve"}
    assert words.totals.first().n_docs == e.table("chunks").count()


def test_contexts_carry_their_document(spark, engine):
    row = engine().retrieve(asked(spark, "right triangle angle")).orderBy("place").first()
    assert (row.source_name, row.subject, row.grade, row.chapter, row.file_type) == ("lop 9 toan chuong 2.txt", "toan", "Lop 9", "Chuong 2", ".txt")
    slide = engine().retrieve(asked(spark, "granite below ground")).orderBy("place").limit(1)
    assert "\nSlide: 1\n" in slide.select(evidence.context_block().alias("t")).first().t
    named = slide.select(evidence.result().alias("r")).first().r.asDict()
    assert list(named) == evidence.FIELDS and named["location_label"] == "slide" and named["similarity"] == named["dense_score"]


class Leafy:
    """Prefers one fact; its raw scores need squashing."""

    def __call__(self, pairs):
        return [5.0 if "leaf" in payload else -5.0 for _, payload in pairs]


def test_reranker(spark, engine):
    question = asked(spark, "a curve and a leaf")
    plain = engine().retrieve(question).collect()
    ranked = {r.chunk_id: r for r in engine(Leafy).retrieve(question).collect()}
    assert {round(r.rerank_score, 3) for r in ranked.values()} == {0.993, 0.007}
    assert all(("leaf" in r.parent_content) == (r.rerank_score > 0.5) for r in ranked.values())
    unused = engine(Leafy, use_reranker=False).retrieve(question).collect()
    assert sorted((r.chunk_id, r.final_score) for r in unused) == sorted((r.chunk_id, r.final_score) for r in plain)


def test_search_settings(spark, engine):
    question = asked(spark, "zzz unknown words")
    assert engine(min_similarity=0.99).retrieve(question).count() == 0 < engine(min_similarity=0.0).retrieve(question).count()
    curve = asked(spark, "area under a curve")
    assert engine(use_hybrid=False).retrieve(curve).filter("sparse_score > 0").count() == 0
    exact, near = (sorted((r.chunk_id, r.dense_score) for r in engine(use_lsh=x).retrieve(curve).collect()) for x in (False, True))
    assert exact == near  # so few vectors are all candidates
    few = replace(Settings(), top_k=1, top_k_dense=4, top_k_sparse=4, fusion_top_k=4, use_hybrid=False, min_similarity=0.0)
    one = Engine(spark, engine().store.path, replace(few, ann_candidates=3)).retrieve(curve).count()
    more = Engine(spark, engine().store.path, replace(few, ann_candidates=9, fusion_top_k=12)).retrieve(curve).count()
    assert one < more


def test_gate_settings(spark):
    rows = spark.createDataFrame([(0, i, s, "p", 0.9) for i, s in enumerate([0.9, 0.6, 0.5, 0.4])], "query_id long, chunk_id long, final_score double, parent_key string, rerank_score double")
    question = asked(spark, "?")
    clarify = lambda **limits: evidence.gate(rows, question, True, evidence.Limits(**limits)).first().needs_clarification
    assert not clarify()
    assert clarify(confidence=0.99) and clarify(margin=0.5) and clarify(gap=0.4) and clarify(rerank=0.95)


class Echo:
    """Tells what it was asked, so that prompts can be read from the answer."""

    def __call__(self, prompt):
        return f"facts of <{prompt}>" if prompt.startswith("Ban la bo loc") else f"answer to <{prompt}>"


def open_gate(**more):
    return {"low_confidence": 0.0, "low_margin": 0.0, "low_gap": 0.0, "rerank_low": 0.0, **more}


def test_answers_with_and_without_a_model(spark, engine):
    question = asked(spark, "What does an integral measure?", "qqq www")
    e = engine(**open_gate(evidence_sentence_min=8, evidence_sentence_max=10))
    result = e.ask(question, Echo)
    row = result.answers.filter("query_id = 0").first()
    assert row.provider == "model" and row.answer.startswith("answer to <") and "FACT PACKAGE:\nfacts of <" in row.answer
    assert row.answer.count(" [Nguon 1: ") + row.answer.count(" [Nguon 2: ") > 0 and "Evidence rut gon:\n- " in row.answer and f"Do tin cay truy hoi: {row.confidence:.3f}" in row.answer
    assert row.answer.split("Evidence rut gon:\n")[1].split("\n\nContext")[0].count("\n- ") == 9
    bare = engine(**open_gate(compress_evidence=False)).ask(question, Echo).answers.filter("query_id = 0").first()
    assert prompts.NO_EVIDENCE in bare.answer
    local = e.ask(question).answers.filter("query_id = 0").first()
    assert local.provider == "local" and local.answer.startswith("Khong goi duoc model") and "Nguon da dung:\n- [Nguon 1] " in local.answer
    strict = engine(low_confidence=1.0).ask(question, Echo)
    assert {(r.provider, r.needs_clarification) for r in strict.answers.collect()} == {("local", True)}
    assert strict.contexts.filter("query_id = 0").count() >= result.contexts.filter("query_id = 0").count() > 0


def test_what_an_answer_was_read_from_can_be_released(spark, engine):
    with scratch() as made:
        assert engine().ask(asked(spark, "a leaf")).answers.count() == 1
        assert made.made and all(os.path.exists(t.stage_path) for t in made.made)
        paths = [t.stage_path for t in made.made]
        made.release()
    assert not any(map(os.path.exists, paths))


def test_models_are_asked_in_turn():
    fails = lambda: lambda prompt: 1 / 0
    silent, speaks = (lambda said=said: lambda prompt: said for said in ("", "yes"))
    assert chain(fails, silent, speaks)()("?") == "yes" and chain(silent, fails)()("?") == ""


def test_no_contexts_have_a_fixed_answer(spark):
    row = spark.createDataFrame([(None, None, "q")], "sources_text string, facts string, text string")
    assert row.select(prompts.local_answer(F.col("facts")).alias("a")).first().a == prompts.NO_CONTEXT


def test_batches_count_when_they_are_committed(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "docs" / name).write_text(page("An old fact stands here.", 5))
    e = Engine(spark, str(tmp_path / "store"))
    e.ingest_folder(str(tmp_path / "docs")).collect()
    before = sorted(r.content for r in e.table("chunks").collect())
    (tmp_path / "docs" / "a.txt").write_text(page("A new fact stands here.", 5))
    whole = e.store._fs
    e.store._fs = lambda path: (_ for _ in ()).throw(OSError("lost")) if path.endswith("/_log/000000002") else whole(path)
    with pytest.raises(OSError, match="lost"):
        e.ingest_folder(str(tmp_path / "docs"))
    e.store._fs = whole
    assert sorted(r.content for r in e.table("chunks").collect()) == before
    e.ingest_folder(str(tmp_path / "docs" / "a.txt")).collect()
    now = sorted(r.content for r in e.table("chunks").collect())
    assert any("new fact" in c for c in now) and len(now) == len(before) and sum("old fact" in c for c in now) == len(before) // 2
    state = lambda: {n: sorted(map(str, e.table(n).collect())) for n in ("documents", "chunks", "parents", "map", "postings")}
    want = state()
    e.store.compact()
    assert state() == want and len(e.store.log()) == 1
    e.store.sweep()
    assert state() == want
    e.remove(e.table("documents").filter("source_name = 'a.txt'").select("source_path"))
    assert all(e.table(n).count() < len(want[n]) for n in want)


def test_parsers_read_other_files(spark, tmp_path):
    (tmp_path / "x.scan").write_bytes(b"first|second")
    found = files.scan(spark, str(tmp_path))
    rows = files.spans(found, {".scan": lambda data: data.decode().split("|")}).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in rows] == [(1, "first"), (2, "second")]


@pytest.mark.parametrize("pages", [["H\na\nF", "H\nb\nF", "H\nc\nG"], ["H\na", "H\nb"], ["H", "H", "H", ""], ["a\nF", "b\nF", "", "c\nF"]])
def test_page_noise_of_a_file(spark, pages):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "document_id long, page_number int, text string")
    assert files.without_noise(pages) == [r.text for r in sections.without_page_noise(rows).orderBy("page_number").collect()]


def test_dotenv(tmp_path):
    (tmp_path / ".env").write_text("# comment\nGLEANER_TOP_K=7\nexport GLEANER_LOW_GAP='0.5'\nGLEANER_USE_LSH=yes\n")
    s = Settings.from_env({"GLEANER_TOP_K": "5"}, dotenv=str(tmp_path / ".env"))
    assert (s.top_k, s.low_gap, s.use_lsh) == (5, 0.5, True)
