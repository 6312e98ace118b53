"""What a worker holds of a batch of texts must not grow with the batch's rows."""

import tracemalloc

import pyarrow as pa
import pytest
from gleaner.functions.frames import BATCH_BYTES
from gleaner.llm import bpe, common, jaccard, toxicity
from gleaner.llm.common import by_piece
from gleaner.llm.queries import tokenizer_path

RUNS = {
    "toxicity": lambda docs: toxicity.score(docs, None),
    "round_trip": lambda docs: bpe.round_trip(docs, tokenizer_path()),
    "encode": lambda docs: bpe.encode(docs, tokenizer_path()),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_worker_holds_a_piece(spark, monkeypatch, name):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    with monkeypatch.context() as m:
        caught = []
        m.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self.withColumnRenamed("doc_id", "id"))
        RUNS[name](docs)

    def held(rows):
        batch = pa.RecordBatch.from_pydict({"id": list(range(rows)), "text": ["a" * 3_000] * rows})
        tracemalloc.start()
        made = sum(len(out) for out in caught[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == rows
        return most

    held(10)  # reads the vocabulary
    assert held(3_000) < 1.5 * held(600)


def test_pieces_keep_rows_and_null_texts():
    batches = [pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["ab", None, "cde"]}), pa.RecordBatch.from_pydict({"id": [4], "text": ["f" * 9]}), pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    assert [(texts, part.column("id").to_pylist()) for texts, part in by_piece(iter(batches), size=4)] == [(["ab", ""], [1, 2]), (["cde"], [3]), (["f" * 9], [4])]


def test_a_worker_keeps_only_the_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self.withColumnRenamed("doc_id", "id"))
    for make in (bpe.encode, bpe.round_trip):
        make(docs, tokenizer_path())
        rows = [out.column("ids").to_pylist() for out in caught[-1](iter([pa.RecordBatch.from_pydict({"id": [1], "text": ["some words of a text"]})]))]
        found = bpe.tokenizer(tokenizer_path())
        assert rows[0][0] and not (found.known or found.older or found.clean)


@pytest.mark.parametrize("make", [lambda docs: toxicity.score(docs, None), lambda docs: bpe.digests(docs, tokenizer_path()), lambda docs: bpe.encode(docs, tokenizer_path()), jaccard.signatures])
def test_batches_have_bounded_bytes(spark, make):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('a', 3000) AS text")
    try:
        spark.conf.set(name, "64MB")
        make(docs)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [len(b)]}) for b in batches), "n long, rows long").collect()
        assert max(r.n for r in sizes) < 1.1 * BATCH_BYTES and sum(r.rows for r in sizes) == 6_000
        spark.conf.set(name, "1MB")  # a smaller limit of the session's own stays
        make(docs)
        assert spark.conf.get(name) == "1MB"
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("make", [lambda docs: toxicity.score(docs, None), jaccard.signatures])
def test_later_stages_let_the_vocabulary_go(spark, monkeypatch, make):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self.withColumnRenamed("doc_id", "id"))
    make(docs)
    bpe.tokenizer(tokenizer_path())
    assert common._RESIDENT
    list(caught[0](iter([])))
    assert not common._RESIDENT
