"""Exact Unicode forms, as Arrow-batched functions, and their registration."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleaner.functions.frames import pieces
from gleaner.functions.text import INTENTS, KEYWORDS, STOP_WORDS, accents, folds

_TERM = re.compile(r"\w{2,}").findall
_STOP = frozenset(STOP_WORDS)


def bare(text: str) -> str:
    apart = unicodedata.normalize("NFKD", text)
    for mark in () if apart.isascii() else filter(unicodedata.combining, set(apart)):
        apart = apart.replace(mark, "")
    return apart


def terms_of(text: str) -> list[str]:
    """T7 as search uses it: without accents and stop words. White space only
    separates, so T2 and T3 need no passes of their own."""
    return [t for t in _TERM(bare(text.casefold())) if t not in _STOP]


@cache
def _tables() -> list[dict[str, str]]:
    return [dict(zip(*pairs(), strict=True)) for pairs in (folds, accents)]


def matched(text: str) -> str:
    """text.match_text() without accents, for one text: what isn't ASCII is
    replaced letter by letter, in the order of the Column form."""
    text = text.lower()
    if not text.isascii():
        text = text.replace("ß", "ss").replace("\u200b", " ")
        for table in _tables():
            for letter in set(text) & table.keys():
                text = text.replace(letter, table[letter])
        for mark in (ch for ch in set(text) if unicodedata.category(ch) == "Mn"):
            text = text.replace(mark, "")
    return " ".join(text.split())


def stands(phrase: str, text: str) -> bool:
    """Whether the phrase stands in the text between borders of words."""
    at = text.find(phrase)
    while at >= 0:
        around = text[max(0, at - 1) : at] + text[at + len(phrase) : at + len(phrase) + 1]
        if not any(ch == "_" or unicodedata.category(ch)[0] in "LN" for ch in around):
            return True
        at = text.find(phrase, at + 1)
    return False


def intent_of(text: str) -> str:
    low = matched(text)
    return next((label for label, phrases in INTENTS if any(stands(p, low) for p in phrases.split("|"))), "general")


def labels_of(text: str) -> str:
    low = matched(text)
    return ",".join(label for label, variants in KEYWORDS if any(v in low for v in variants))


def each_of(make):
    """A text function as a Column function, over a batch piece by piece; null is
    the empty text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([make(x or "") for at in pieces(texts) for x in texts[at].to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


#: T12 and T11 (joined by commas) of whole documents: text.intent() and
#: text.keywords() take some ten passes of expressions over each text.
intents, labels = each_of(intent_of), each_of(labels_of)


@F.arrow_udf(ArrayType(StringType()))
def terms(texts: pa.Array) -> pa.Array:
    """text.terms() for every script. One pass of Python's compiled expressions
    over a batch, piece by piece; the eight Column expressions that say the same
    take several times as long (README)."""
    kind = pa.list_(pa.string())
    found = [pa.array([None if x is None else terms_of(x) for x in texts[at].to_pylist()], kind) for at in pieces(texts)]
    return pa.concat_arrays(found) if found else pa.array([], kind)


@F.pandas_udf(StringType())
def three_places(numbers: pd.Series) -> pd.Series:
    """Numbers as Python's %.3f writes them: the binary value is rounded."""
    return numbers.map(lambda x: f"{x:.3f}", na_action="ignore")


@F.pandas_udf(StringType())
def strip_diacritics_exact(texts: pd.Series) -> pd.Series:
    return texts.map(bare, na_action="ignore")


@F.pandas_udf(StringType())
def casefold_exact(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


def register(spark: SparkSession) -> None:
    """Makes the text functions callable from SQL."""
    from gleaner.operators import chunking

    spark.udf.register("strip_diacritics", strip_diacritics_exact)
    spark.udf.register("casefold", casefold_exact)
    spark.udf.register("search_terms", terms)
    spark.udf.register("clean_text", F.pandas_udf(lambda s: s.map(chunking.clean, na_action="ignore"), "string"))
    spark.udf.register("split_sentences", F.pandas_udf(lambda s: s.map(chunking.sentences, na_action="ignore"), "array<string>"))
    spark.udf.register("estimate_tokens", F.pandas_udf(lambda s: s.map(chunking.estimate, na_action="ignore"), "long"))
    spark.udtf.register("chunk_text", F.udtf(chunking.ChunkText, returnType="parent_index int, child_index int, section string, content string"))
