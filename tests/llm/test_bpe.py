import hashlib
import random
import time

import pytest
from gleaner.llm import bpe
from gleaner.llm.queries import tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.TrieBpe(PATH)


def ids_of(text):
    from array import array

    return array("i", OWN.encode_all([text])[0]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdethinsogr '.\n1é", max_size=60)))
def test_same_as_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == expected
    assert OWN.decode(expected) == LIBRARY.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b<|endoftext|>", "  x   ", "it's they'LL", "a" * 5000, "日本語 ёж \x85\x1c"])
def test_odd_texts(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "abcABCxyzXYZ", "a"])
def test_long_unbroken_words_take_time_in_proportion(letters):
    rng = random.Random(3)
    text = "".join(rng.choice(letters) for _ in range(100_000))
    began = time.perf_counter()
    found = ids_of(text)
    assert time.perf_counter() - began < 10
    assert found == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_digests(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, "y"), (2, "", "z"), (3, "é" * 9000 + " tail", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=str)
    expected = []
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert out == sorted(expected, key=str)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
