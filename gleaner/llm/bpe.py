"""BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut into words by the vocabulary's pattern. The distinct words of a
batch go into a trie of bytes. A depth-first walk keeps, for every prefix on the
path, the last token of that prefix's encoding: it is the one token that ends
the prefix and joins cleanly with the last token of what stands before it. The
encoding of a shared prefix is therefore worked out once for all words below
it, and a word's tokens are read back along its path.

Defined results: a null text encodes as the empty text (no ids); null or empty
ids decode to the empty text. The added token's own text inside a document is
encoded as that token, as the public library does. Rows are never dropped or
merged; ids may repeat or be null, and other columns are left alone.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batched, by_piece, give_back, resident

#: Fixed by the format of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words and token pairs that a worker remembers before it starts anew.
WORDS_KEPT, PAIRS_KEPT = 60_000, 150_000
#: The classes of PATTERN among characters below U+0250, for Python's faster engine.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
_CUT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_WIDE = re.compile("[^\x00-\u024f]").search


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class TrieBpe:
    """A byte-level vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.bytes, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = rank
            if whole not in self.halves:
                self.rank[whole], self.halves[whole] = rank, (a, b)
        added = spec.get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        self.bytes |= {t["id"]: t["content"].encode() for t in added}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.cut = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        """Only the vocabulary stays, as a worker does when its task has ended."""
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.clean: dict[int, bool] = {}

    def joins(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between tokens a and b.
        The merges that made them are undone from the last to the first; each
        pair that met at the border must have had a higher rank than what in
        fact happened to its sides next."""
        found = self.clean.get(a << 20 | b)
        if found is not None:
            return found
        rank, halves, pairs, key = self.rank, self.halves, self.pairs, a << 20 | b
        next_a = next_b = float("inf")
        good = True
        while True:
            r = pairs.get((a, b))
            if r is not None and r < next_a and r <= next_b:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                next_a, a = ra, halves[a][1]
            else:
                next_b, b = rb, halves[b][0]
        if len(self.clean) >= PAIRS_KEPT:
            self.clean.clear()
        self.clean[key] = good
        return good

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet. The trie is held as its words
        in sorted order: a depth-first walk meets them in that order, and what a
        word shares with the one before it is the path that stays on the stack."""
        ids, joins, clean, known, longest = self.ids, self.joins, self.clean, self.known, self.longest
        last: list[int] = []
        sizes: list[int] = []
        before = b""
        for word in sorted(w.encode("utf-8") for w in words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            del sizes[shared:]
            for end in range(shared + 1, len(word) + 1):
                # exactly one token fits, none longer than the vocabulary's longest;
                # the one that grows the last token and the one that starts anew
                # are the likeliest
                grown = end - 1 - sizes[-1] if sizes else 0
                for start in chain((grown, end - 1), range(grown - 1, max(0, end - longest) - 1, -1), range(end - 2, grown, -1)):
                    token = ids.get(word[start:end])
                    if token is None:
                        continue
                    if start == 0:
                        break
                    before_it = last[start - 1]
                    good = clean.get(before_it << 20 | token)
                    if good or good is None and joins(before_it, token):
                        break
                last.append(token)
                sizes.append(end - start)
            at, out = len(word), []
            while at:
                out.append(last[at - 1])
                at -= sizes[at - 1]
            out.reverse()
            known[word.decode("utf-8")] = array("i", out).tobytes()
            before = word

    def parts(self, text: str) -> list[str]:
        return self.split_added.split(text) if self.split_added else [text]

    def words(self, text: str) -> list[str]:
        return (self.cut if _WIDE(text) else _CUT_LATIN)(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of int32."""
        cuts = [[p if p in self.added else self.words(p) for p in self.parts(t) if p] for t in texts]
        all_words = set(chain.from_iterable(part for doc in cuts for part in doc if not isinstance(part, str)))
        if len(self.known) + len(all_words) > 2 * WORDS_KEPT:
            self.known, self.older = {}, {}
        elif len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        new = all_words - self.known.keys()
        if self.older:
            for word in new & self.older.keys():
                self.known[word] = self.older[word]
                new.discard(word)
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(array("i", [self.added[part]]).tobytes() if isinstance(part, str) else b"".join(map(get, part)) for part in doc) for doc in cuts]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer(path: str) -> TrieBpe:
    """The tokenizer of that file, read once in each worker process."""
    return resident(path, lambda: TrieBpe(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, ids array<int>) for every row of docs. path: a tokenizer
    file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for texts, part in by_piece(batches):
            found = bpe.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])
        bpe.forget()
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    out = batched(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id_column, ids, text) for every row of encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = batch.column("ids")
            flat, sizes = ids.flatten().to_pylist(), np.diff(ids.offsets.to_numpy())
            texts, at = [], 0
            for n in sizes:
                texts.append(bpe.decode(flat[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, pa.array(texts, pa.string())], ["id", "ids", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    out = encoded.select(F.col(id_column).alias("id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """encode() and decode() in one pass: (id_column, ids, text), the text
    being what the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for texts, part in by_piece(batches):
            found = bpe.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            back = pa.array([bpe.decode(memoryview(x).cast("i")) for x in found], pa.string())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids, back], ["id", "ids", "text"])
        bpe.forget()
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    out = batched(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_column)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes every text; token count and digests of both."""
    return round_trip(docs, path, id_column, text_column).select(
        id_column,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
