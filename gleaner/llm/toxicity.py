"""Toxicity by a bidirectional gated recurrent network in numpy.

A text is its lower-case words. Each word enters the network as the vector of
its hashed bucket beside the scaled sum of the vectors of its character runs
(three to five letters, word edges marked). A GRU reads a window of words in
each direction, attention pools its states, and a logistic unit scores the
window. All windows of a text are scored, each overlapping the next by STRIDE
less than LENGTH words; the text's score is that of its worst window.

Training is by hand-written backpropagation on a bounded sample: up to
TRAIN_TOXIC toxic and TRAIN_CLEAN clean labelled ids in the order of a hash, of
these as many different texts, as long as all have no more than TRAIN_TOTAL
characters. A text of over TRAIN_CHARS characters is learned from SLICES slices
of it, evenly spread, that many characters in all. Each text stands for itself
by its worst window at that time. Scoring covers every row and whole texts.

Defined results: a text without words (null ones too) scores 0. Without both
kinds of labels every score is 0. Labels of one id that contradict each other
count as toxic; labels without a row are ignored. Repeated rows score equally
and are learned from once. Only id and text are read of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batched, by_piece, give_back, vacate

LENGTH, STRIDE = 64, 32
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, SLICES, TRAIN_TOTAL = 2000, 3000, 200_000, 10, 50_000_000
WORD_BUCKETS, RUN_BUCKETS, WIDTH, HIDDEN = 1 << 14, 1 << 16, 8, 8
STEPS, BATCH, RATE = 600, 64, 0.01
#: Times that training may meet each toxic text, and after which shares of the steps the worst windows are sought anew.
PASSES, MINED = 100, (0.1, 0.25, 0.5, 0.75)
#: Training texts in which a bucket must occur to have a vector; damps the steps of buckets with small gradients.
MET, DAMPING = 4, 1e-4
#: Distinct words whose network inputs a worker remembers before it starts anew.
WORDS_KEPT = 150_000
_WORDS = re.compile(r"\w+").findall


def runs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character runs, word after word, and each word's count."""
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    found, of = [], []
    word = np.repeat(np.arange(len(words)), sizes)
    for n in (3, 4, 5):
        good = np.flatnonzero(at + n <= ends)
        code = np.full(len(good), n, np.uint64)
        for k in range(n):
            code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (data[good + k] + np.uint64(k + 1))
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((code >> np.uint64(40)).astype(np.int64) % RUN_BUCKETS)
        of.append(word[good])
    flat, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return flat[order], np.bincount(of, minlength=len(words))


def squash(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """words, runs: vectors by bucket. inward (2, 2 WIDTH, 3 HIDDEN), bias and
    inner (2, HIDDEN, 3 HIDDEN): the GRU of each direction, its gates in the
    order update, reset, new. look: attention. out, shift: the logistic unit."""

    words: np.ndarray
    runs: np.ndarray
    inward: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    look: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def start(cls, seed: int = 9) -> Network:
        rng = np.random.default_rng(seed)
        r = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(r(0.1, WORD_BUCKETS, WIDTH), r(0.1, RUN_BUCKETS, WIDTH), r(0.3, 2, 2 * WIDTH, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), r(0.3, 2, HIDDEN, 3 * HIDDEN), r(0.3, 2 * HIDDEN), r(0.3, 2 * HIDDEN), np.full(1, -1.0, np.float32))

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """One row for each word, and what the backward pass needs of it."""
        buckets = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))
        runs, counts = runs_of(words)
        scale = (1 / np.sqrt(counts)).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        chars = np.add.reduceat(self.runs[runs], starts, axis=0) * scale[:, None]
        return np.concatenate([self.words[buckets], chars], axis=1), (buckets, runs, counts, scale)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of all gates, (2, words + 1, 3 HIDDEN); the last row is padding."""
        p = np.matmul(x, self.inward) + self.bias[:, None]
        return np.concatenate([p, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)

    def read(self, table: np.ndarray, at: np.ndarray, pad: int, keep: list | None = None) -> np.ndarray:
        """Logits of windows at (B, length): rows of table, pad where none."""
        size, length = at.shape
        there = (at != pad).astype(np.float32)
        states = np.zeros((length, size, 2, HIDDEN), np.float32)
        h = np.zeros((2, size, HIDDEN), np.float32)
        for t in range(length):
            ahead, back = at[:, t], at[:, length - 1 - t]
            x = np.stack([table[0].take(ahead, axis=0), table[1].take(back, axis=0)])
            on = np.stack([there[:, t], there[:, length - 1 - t]])[:, :, None]
            u = np.matmul(h, self.inner)
            gates = squash(x[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
            z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            new = np.tanh(x[:, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
            after = new + z * (h - new)
            if keep is not None:
                keep.append((h, u, gates, new, on))
            h = after * on
            states[t, :, 0] = h[0]
            states[length - 1 - t, :, 1] = h[1]
        s = states.reshape(length, size, 2 * HIDDEN)
        e = np.where(there.T > 0, s @ self.look, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("lb,lbh->bh", a, s)
        if keep is not None:
            keep.append((s, a, pooled, there))
        return pooled @ self.out + self.shift

    def logits_of(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """Logits of all windows over these words."""
        parts = [self.project(self.inputs(words[lo : lo + 20_000])[0])[:, :-1] for lo in range(0, len(words), 20_000)]
        table = np.concatenate([*parts, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)
        return np.concatenate([self.read(table, at[lo : lo + 2048], len(words)) for lo in range(0, len(at), 2048)])

    def backward(self, at: np.ndarray, x: np.ndarray, table: np.ndarray, keep: list, d: np.ndarray, parts: tuple) -> dict[str, np.ndarray]:
        """Gradients, d being the loss's by the logits."""
        s, a, pooled, there = keep.pop()
        length, size = at.shape[1], at.shape[0]
        g = {"out": pooled.T @ d, "shift": d.sum(keepdims=True)}
        dp = d[:, None] * self.out
        da = np.einsum("bh,lbh->lb", dp, s)
        de = a * (da - (a * da).sum(axis=0))
        g["look"] = np.einsum("lb,lbh->h", de, s)
        ds = (a[:, :, None] * dp + de[:, :, None] * self.look).reshape(length, size, 2, HIDDEN)
        g["inner"] = np.zeros_like(self.inner)
        dtable = np.zeros_like(table)
        dh = np.zeros((2, size, HIDDEN), np.float32)
        for t in reversed(range(length)):
            h, u, gates, new, on = keep[t]
            z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
            dh = (dh + np.stack([ds[t, :, 0], ds[length - 1 - t, :, 1]])) * on
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * u[:, :, 2 * HIDDEN :] * r * (1 - r)
            dx = np.concatenate([dz, dr, dnew], axis=2)
            du = np.concatenate([dz, dr, dnew * r], axis=2)
            g["inner"] += np.matmul(h.transpose(0, 2, 1), du)
            dh = dh * z + np.matmul(du, self.inner.transpose(0, 2, 1))
            for side, where in ((0, at[:, t]), (1, at[:, length - 1 - t])):
                np.add.at(dtable[side], where, dx[side])
        dtable = dtable[:, :-1]
        g["bias"] = dtable.sum(axis=1)
        g["inward"] = np.matmul(x.T, dtable)
        dx = np.einsum("dwg,dig->wi", dtable, self.inward)
        buckets, runs, counts, scale = parts
        g["words"] = (buckets, dx[:, :WIDTH])
        g["runs"] = (runs, np.repeat(dx[:, WIDTH:] * scale[:, None], counts, axis=0))
        return g


def windows_of(sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows over texts of so many words that follow each
    other, (windows, LENGTH), pad beyond a text's end; and windows by text."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - LENGTH) // STRIDE)), 0)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = (np.repeat(begin, count) + nth * STRIDE)[:, None] + np.arange(LENGTH)
    return np.where(at < np.repeat(begin + sizes, count)[:, None], at, pad), count


class Scorer:
    """A network with the inputs of the words it has met."""

    def __init__(self, network: Network, kept: int = WORDS_KEPT):
        self.network, self.kept = network, kept
        self.forget(0)

    def forget(self, room: int) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((2, max(room, self.kept) + 1, 3 * HIDDEN), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) >= self.table.shape[1]:
            new = list(dict.fromkeys(words))
            self.forget(len(new) + 1)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            at = len(self.known)
            self.table[:, at : at + len(some)] = self.network.project(self.network.inputs(some)[0])[:, :-1]
            self.known.update(zip(some, range(at, at + len(some)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All windows' logits, and windows by text."""
        cut = [_WORDS(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for c in cut for w in c]
        at, count = windows_of(sizes, len(words))
        rows = self.rows(words)
        pad = self.table.shape[1] - 1
        rows = np.append(rows, pad)
        out = [self.network.read(self.table, rows[at[lo : lo + 2048]], pad) for lo in range(0, len(at), 2048)]
        return (np.concatenate(out) if out else np.zeros(0, np.float32)), count

    def scores(self, texts: list[str]) -> np.ndarray:
        logits, count = self.logits(texts)
        out = np.full(len(texts), -np.inf)
        has = count > 0
        if has.any():
            out[has] = np.maximum.reduceat(logits, (np.cumsum(count) - count)[has])
        return np.where(has, 1 / (1 + np.exp(-np.clip(out, -60, 60))), 0.0)


def common(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets of words and of character runs MET texts or more have; the
    others stay zero, so that a rare word says nothing by itself."""
    words, runs = np.zeros(WORD_BUCKETS, np.int32), np.zeros(RUN_BUCKETS, np.int32)
    for text in texts:
        if own := list(set(_WORDS(text.lower()))):
            words[np.unique([crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in own])] += 1
            runs[np.unique(runs_of(own)[0])] += 1
    return words >= MET, runs >= MET


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 9) -> Network | None:
    """The network fitted to these texts; None without both kinds of labels."""
    labels = np.asarray(labels, np.float32)
    if not 0 < labels.sum() < len(labels):
        return None
    network, rng = Network.start(seed), np.random.default_rng(seed)
    for table, often in zip((network.words, network.runs), common(texts), strict=True):
        table[~often] = 0
    place: dict[str, int] = {}
    each = [np.array([place.setdefault(w, len(place)) for w in _WORDS(t.lower())], np.int32) for t in texts]
    vocabulary = list(place)
    at, count = windows_of(np.array([len(x) for x in each]), sum(map(len, each)))
    at = np.concatenate([*each, np.array([len(place)], np.int32)])[at]
    del place, each
    begin = np.cumsum(count) - count
    groups = [np.flatnonzero((labels == y) & (count > 0)) for y in (0, 1)]
    if not all(map(len, groups)):
        return None
    worst = begin + (rng.random(len(count)) * count).astype(int)
    names = ["words", "runs", "inward", "bias", "inner", "look", "out", "shift"]
    first = {n: np.zeros_like(getattr(network, n)) for n in names}
    second = {n: np.zeros_like(getattr(network, n)) for n in names}
    steps = min(steps, max(60, int(PASSES * len(groups[1]) / (BATCH // 3))))
    marks = {int(steps * share) for share in MINED}
    for step in range(1, steps + 1):
        if step in marks:  # each text's worst window by the network as it is
            logits = network.logits_of(vocabulary, at)
            worst = np.array([b + int(logits[b : b + n].argmax()) if n else 0 for b, n in zip(begin, count, strict=True)])
        pick = np.concatenate([rng.choice(groups[1], BATCH // 3), rng.choice(groups[0], BATCH - BATCH // 3)])
        # a clean text is clean everywhere, so half of those show any window
        chosen = np.where((labels[pick] == 0) & (rng.random(len(pick)) < 0.5), begin[pick] + (rng.random(len(pick)) * count[pick]).astype(int), worst[pick])
        own, local = np.unique(at[chosen], return_inverse=True)
        words = [vocabulary[i] for i in own if i < len(vocabulary)]
        local = np.minimum(local.reshape(len(pick), LENGTH), len(words))
        x, parts = network.inputs(words)
        table, keep = network.project(x), []
        logits = network.read(table, local, len(words), keep)
        d = ((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - labels[pick]).astype(np.float32) / len(pick)
        grads = network.backward(local, x, table, keep, d, parts)
        for name in names:
            value, grad = getattr(network, name), grads[name]
            if isinstance(grad, tuple):  # only the rows that were met
                some, back = np.unique(grad[0], return_inverse=True)
                total = np.zeros((len(some), value.shape[1]), np.float32)
                np.add.at(total, back, grad[1])
                total[~value[some].any(axis=1)] = 0
            else:
                some, total = slice(None), grad
            first[name][some] = 0.9 * first[name][some] + 0.1 * total
            second[name][some] = 0.99 * second[name][some] + 0.01 * total * total
            value[some] -= RATE * (first[name][some] / (1 - 0.9**step)) / (np.sqrt(second[name][some] / (1 - 0.99**step)) + DAMPING)
    return network


def sliced(text: Column) -> Column:
    """A text, or evenly spread slices of one that is too long to learn from whole."""
    piece = TRAIN_CHARS // SLICES
    starts = [F.floor((F.length(text) - piece) * (k / (SLICES - 1))).cast("int") + 1 for k in range(SLICES)]
    return F.when(F.length(text) > TRAIN_CHARS, F.concat_ws(" ", *[text.substr(at, F.lit(piece)) for at in starts])).otherwise(text)


def sample(docs: DataFrame, labels: DataFrame, learn, id_column: str, text_column: str, label: str) -> tuple[list[str], np.ndarray]:
    """The bounded training sample, collected; learn: which ids may be used.
    Which texts are taken is settled on their digests, so that no more texts
    than that are ever brought together, however often an id repeats."""
    ids = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull()).filter(learn).groupBy(F.col(id_column).alias("label_id")).agg(F.max(label).alias("y"))
    order = F.xxhash64("label_id")
    chosen = ids.filter("y = 1").orderBy(order).limit(TRAIN_TOXIC).union(ids.filter("y = 0").orderBy(order).limit(TRAIN_CLEAN))
    rows = docs.select(F.col(id_column).alias("label_id"), sliced(F.coalesce(F.col(text_column), F.lit(""))).alias("text"))
    rows = rows.join(F.broadcast(chosen), "label_id").withColumn("digest", F.md5(F.col("text").cast("binary")))
    marks = rows.select("label_id", "digest", F.length("text").alias("chars")).distinct().orderBy(order, "digest").limit(TRAIN_TOXIC + TRAIN_CLEAN).toPandas()
    marks = marks[marks["chars"].cumsum() <= TRAIN_TOTAL]
    if not len(marks):
        return [], np.zeros(0)
    taken = docs.sparkSession.createDataFrame(marks[["label_id", "digest"]], rows.select("label_id", "digest").schema)
    found = rows.join(F.broadcast(taken), ["label_id", "digest"]).groupBy("label_id", "digest", "y").agg(F.first("text").alias("text")).toArrow().to_pylist()
    found.sort(key=lambda r: (crc32(str(r["label_id"]).encode()), r["digest"]))
    return [r["text"] for r in found], np.array([r["y"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic") -> Network | None:
    return train(*sample(docs, labels, learn, id_column, text_column, label))


def score(docs: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        scorer = Scorer(network) if network is not None else None
        for texts, part in by_piece(batches):
            found = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.float64())], ["id", "score"])
        scorer = None
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
