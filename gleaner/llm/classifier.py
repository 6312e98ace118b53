"""Quality classifier: random-indexing word vectors and a small numpy network.

Tokens (words, single digits, single marks) fall into buckets by a hash, apart
for each shape of token. Each bucket owns a fixed sparse index vector. Over all
rows of the corpus, a bucket's vector is the sum of its neighbours' index
vectors within REACH tokens. A document is the pooled vectors of all its tokens
(mean, spread, coherence of neighbours, concentration, length); a network with
one hidden layer reads that, and a temperature, fitted on labelled rows that the
weights haven't seen, calibrates its probabilities.

Corpus sums are added as columns of whole numbers, so that their order doesn't
matter, with map-side combining; SIZE x DIM numbers reach the driver whatever
the input. Labelled rows for the fit are bounded by TRAIN_ROWS, taken in the
order of a hash of their ids; features and scores cover every row and whole
texts. Only the text is read by a score.

Defined results: null texts are empty ones, which pool to zeros and get the
score that the network gives those. Without both kinds of labels every score is
0.5. Contradicting labels of one id count as bad.
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

from gleaner.llm.common import list_array, pieces, stage_table, texts_of

#: First bucket and number of buckets of each shape of token.
SHAPES = {"lower": (0, 4096), "capital": (4096, 1024), "upper": (5120, 1024), "other": (6144, 512), "digit": (6656, 64), "mark": (6720, 448)}
SIZE, DIM, REACH = 7168, 32, 2
TRAIN_ROWS, HIDDEN, EPOCHS = 20_000, 16, 60
TOKENS_KEPT = 300_000
FEATURES = 2 * DIM + 3
_TOKENS = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_").findall


def bucket_of(token: str) -> int:
    if token[0].isalpha():
        shape = "lower" if token.islower() else "upper" if token.isupper() and len(token) > 1 else "capital" if token[0].isupper() and token[1:] == token[1:].lower() else "other"
    else:
        shape = "digit" if token.isdigit() else "mark"
    start, size = SHAPES[shape]
    return start + crc32(token.encode("utf-8", "surrogatepass")) % size


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is +1 and where it is -1."""
    rng = np.random.default_rng(6)
    plus = rng.integers(0, DIM, SIZE)
    return plus, (plus + rng.integers(1, DIM, SIZE)) % DIM


class Buckets:
    """Token buckets of texts, remembering tokens it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [_TOKENS(t) for t in texts]
        new = {t for c in cut for t in c} - self.known.keys()
        if len(self.known) + len(new) > TOKENS_KEPT:
            self.known = {}
            new = {t for c in cut for t in c}
        self.known.update((t, bucket_of(t)) for t in new)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.known.__getitem__
        return np.fromiter((b for c in cut for b in map(get, c)), np.int64, int(sizes.sum())), sizes


def neighbour_sums(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(bucket, c0 .. c{DIM - 1}): the corpus's sums of neighbours' index vectors."""
    names = [f"c{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(), np.zeros(SIZE * DIM)
        plus, minus = (np.append(x, 0) for x in index_vectors())
        for batch in batches:
            texts = texts_of(batch, "text")
            for start, end in pieces(texts, 1_000_000):
                flat, sizes = buckets(texts[start:end])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for k in range(1, REACH + 1):
                    same = doc[k:] == doc[:-k]
                    a, b = flat[:-k][same], flat[k:][same]
                    for x, y in ((a, b), (b, a)):
                        total += np.bincount(x * DIM + plus[y], minlength=SIZE * DIM)
                        total -= np.bincount(x * DIM + minus[y], minlength=SIZE * DIM)
        sums = total.reshape(SIZE, DIM).astype(np.int64)
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(np.ascontiguousarray(sums[rows, i])) for i in range(DIM))], ["bucket", *names])

    each = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    return each.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def vectors(sums: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets (zeros for what the corpus doesn't have)."""
    found = sums.toArrow()
    out = np.zeros((SIZE, DIM), np.float32)
    rows = np.stack([found.column(f"c{i}").to_numpy() for i in range(DIM)], axis=1).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    out[found.column("bucket").to_numpy()] = rows / np.maximum(norms, 1e-9)
    return out


def pooled(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Features of texts, (texts, FEATURES)."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    starts = (np.cumsum(sizes) - sizes)[has]
    n = sizes[has][:, None].astype(np.float32)
    v = table[flat]
    mean = np.add.reduceat(v, starts, axis=0) / n
    square = np.add.reduceat(v * v, starts, axis=0) / n
    close = np.append(np.einsum("ij,ij->i", v[:-1], v[1:]), np.float32(0))
    close[np.cumsum(sizes[has]) - 1] = 0
    doc = np.repeat(np.arange(len(has)), sizes[has])
    pairs, times = np.unique(doc * SIZE + flat, return_counts=True)
    focus = np.bincount(pairs // SIZE, weights=times.astype(float) ** 2, minlength=len(has))
    out[has, :DIM] = mean
    out[has, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[has, 2 * DIM] = np.add.reduceat(close, starts) / n[:, 0]
    out[has, 2 * DIM + 1] = np.sqrt(focus) / n[:, 0]
    out[has, 2 * DIM + 2] = np.log1p(n[:, 0])
    return out


def features(docs: DataFrame, table: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, features array<float>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = texts_of(batch, "text")
            for start, end in pieces(texts, 500_000):
                x = pooled(*buckets(texts[start:end]), table)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), list_array(list(x), pa.float32(), np.float32)], ["id", "features"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, features array<float>").withColumnRenamed("id", id_column)


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    b0: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.a + self.a0) @ self.b + self.b0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, seed: int = 6) -> Network | None:
    """Weights from the rows outside calibration, temperature from those in it;
    None without both kinds of labels."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    own, rest = np.flatnonzero(~calibration), np.flatnonzero(calibration)
    if not len(own) or not 0 < y[own].sum() < len(own):
        return None
    rng = np.random.default_rng(seed)
    mean, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = (x - mean) / spread
    p = [rng.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / 4, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for lo in range(0, len(order), 128):
            at, step = order[lo : lo + 128], step + 1
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[at]) / len(at)
            dh = d[:, None] * p[2] * (1 - h * h)
            for i, g in enumerate((z[at].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, spread, p[0], p[1], p[2], float(p[3][0]))
    if len(rest) and 0 < y[rest].sum() < len(rest):
        raw = network.logits(x[rest])
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        loss = [np.mean(np.logaddexp(0, raw / t) - y[rest] * raw / t) for t in tries]
        network.temperature = float(tries[int(np.argmin(loss))])
    return network


def fit(featured: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, id_column: str = "doc_id", label: str = "quality") -> Network | None:
    """learn, calibrate: conditions on the id that mark what may be learned from
    and, of it, what is kept for the temperature."""
    marks = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull()).filter(learn).withColumn("calibrate", calibrate)
    marks = marks.groupBy(F.col(id_column).alias("label_id"), "calibrate").agg(F.min(label).alias("y")).orderBy(F.xxhash64("label_id")).limit(TRAIN_ROWS)
    rows = featured.join(F.broadcast(marks), F.col(id_column) == F.col("label_id")).select("label_id", "features", "y", "calibrate").orderBy("label_id").limit(TRAIN_ROWS).toArrow()
    if not len(rows):
        return None
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(len(rows), FEATURES)
    return train(x, rows.column("y").to_numpy(), np.array(rows.column("calibrate").to_pylist(), bool))


def score(featured: DataFrame, network: Network | None, id_column: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            found = network.scores(x.astype(np.float64)) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    kind = featured.schema[id_column].dataType.simpleString()
    return featured.select(F.col(id_column).alias("id"), "features").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> DataFrame:
    """(id, score) for every row of docs."""
    table = vectors(neighbour_sums(docs, text_column))
    featured = stage_table(features(docs, table, id_column, text_column), "features")
    return score(featured, fit(featured, labels, learn, calibrate, id_column, label), id_column)
