"""What a Python worker holds must not grow with the rows of a batch."""

import tracemalloc

import pyarrow as pa
import pytest
from gleaner.functions import text as T
from gleaner.functions import unicode
from gleaner.functions.frames import BATCH_BYTES, filled, pieces
from gleaner.operators import chunking, fusion, sparse
from pyspark.sql import functions as F

TEXT = " ".join(f"word{i}" for i in range(400))


def held(run, rows):
    """The most bytes that Python holds while it works on one batch of so many rows."""
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(rows)), "document_id": list(range(rows)), "text": [TEXT] * rows})
    tracemalloc.start()
    made = sum(len(out) for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made
    return most


def caught(spark, monkeypatch, make):
    """The function that make gives to mapInArrow."""
    rows = spark.createDataFrame([(1, 1, "")], "chunk_id long, document_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
        return make(rows)


def test_pieces_cover_all_rows():
    texts = pa.array(["a" * 5, None, "b" * 20, "", "c" * 4, "d" * 6])
    assert [(p.start, p.stop) for p in pieces(texts, 10)] == [(0, 2), (2, 3), (3, 6)]
    assert list(pieces(texts[:0])) == []
    assert [(p.start, p.stop) for p in pieces(texts[1:], 10)] == [(0, 1), (1, 2), (2, 5)]


def test_postings_hold_a_piece(spark, monkeypatch):
    run = caught(spark, monkeypatch, lambda df: sparse.posted(df, "text"))
    assert held(run, 3_000) < 1.5 * held(run, 600)


def test_units_hold_a_piece(spark, monkeypatch):
    run = caught(spark, monkeypatch, chunking.unit_rows)
    assert held(run, 3_000) < 1.5 * held(run, 600)


def test_terms_hold_a_piece():
    def most(rows):
        texts = pa.array([TEXT] * rows)
        tracemalloc.start()
        assert len(unicode.terms.func(texts)) == rows
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    assert most(3_000) < 1.5 * most(600)


ODD = [None, "", "la gi", "xla gi", "la gi_", "La  GI?", "định nghĩa là gì", "đinh nghia", "la​gi", "ﬁ la gi", "ｌａ gi", "ΣΑΣ la gis so sánh", "straße chứng minh² chứng minh", "İ CHỨNG\x1fMINH", "ví dụ", "vi du vi_du xvi du", "bai tap1 loi\ngiai", "Ⅷ vi sao ẛ ǅ", " cach laḿ", "x´vi du"]


def test_intents_and_labels_are_those_of_the_column_expressions(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "text string")
    both = rows.select("text", T.intent("text"), unicode.intents("text"), F.array_join(T.keywords("text"), ","), unicode.labels("text"))
    for text, intent, own_intent, labels, own_labels in both.collect():
        assert (text, intent, labels) == (text, own_intent, own_labels)


def test_a_text_is_folded_once(spark):
    for make in (T.intent, T.keywords, lambda c: T.clarification(T.intent(c))):
        plan = spark.range(1).select(make(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1


def test_asked_postings_hold_a_piece(spark, monkeypatch):
    run = caught(spark, monkeypatch, lambda df: sparse.posted(df, "text", only={"word1", "word2"}))
    assert held(run, 3_000) < 1.5 * held(run, 600)


def scored(rows):
    spark = rows.sparkSession
    fused = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.5, 1)], "query_id long, chunk_id long, dense_score double, sparse_score double, rrf_score double, rank int")
    return fusion.score(fused, rows, spark.createDataFrame([(1, "word")], "query_id long, text string"), keep=("content",))


@pytest.mark.parametrize("make", [lambda rows: sparse.posted(rows, "content"), scored])
def test_batches_have_bounded_bytes(spark, make):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 6_000, 1, 1).selectExpr("id AS chunk_id", "repeat('a', 3000) AS content")
    try:
        spark.conf.set(name, "64MB")
        make(rows)
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [len(b)]}) for b in batches), "n long, rows long").collect()
        assert max(r.n for r in sizes) < 1.1 * BATCH_BYTES and sum(r.rows for r in sizes) == 6_000
    finally:
        spark.conf.unset(name)


def test_small_batches_are_joined():
    batches = [pa.RecordBatch.from_pydict({"n": pa.array(range(k), pa.int64())}) for k in (2, 0, 3, 7, 1)]
    joined = list(filled(iter(batches), 4))
    assert [len(b) for b in joined] == [5, 7, 1]
    assert pa.Table.from_batches(joined) == pa.Table.from_batches(batches).combine_chunks()
    assert list(filled(iter([]))) == []
