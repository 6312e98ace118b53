"""N-gram Jaccard join by MinHash banding.

A text's set holds its runs of five lower-case words (its whole word sequence,
if shorter). Texts that are equal byte for byte are one node from the start.
Each node gets MinHash values in bands; the number of bands and of rows in a
band is worked out from the wanted recall at the threshold. Nodes that share a
band's bucket are candidates, and each pair of them is verified once on its full
sets: the intersection is counted, not estimated.

Candidates are dealt into blocks of bounded size in the order of the component
of "shares a bucket with", so that most buckets lie whole in one block. Where a
bucket spans several blocks, only its own nodes are sent to each pair of those
blocks; a long chain of components therefore costs what its buckets cost, not
its square. A block returns one row for each node (its links and the root of its
class), not one for each pair, so groups of thousands of near copies stay linear
in what is stored; no pair is dropped or capped. Joins on buckets, centres and
texts that many rows share deal those rows over several tasks.

Defined results: a class is a connected component of links; class_id is its
smallest document id; n_links counts the other rows that are equal to the
document or linked to it. Texts without words (null ones too) link to nothing:
class_id is their own id. Rows with equal texts, also under one id, are copies
of each other. A null id counts as a row; a class of null ids only has class_id
null. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batched, by_piece, list_array, meet, scratch, small, stage_table, vacate
from gleaner.llm.graphs import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Nodes and set members at which a block of candidates is full.
BLOCK_NODES, BLOCK_MEMBERS = 1000, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold still
    shares a band with that probability, within so many hashes."""
    found = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            found = (bands, rows)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of word runs for whole batches of texts, by prefix sums of a
    polynomial over their bytes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.base = int(_BASE) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            back = pow(self.base, -1, 1 << 64)
            for name, base in (("up", self.base), ("down", back)):
                out = np.full(n, np.uint64(base))
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All gram hashes, text after text, and how many each text has."""
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self._powers(len(data) + 1)
        gap = self.gap[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.up[: len(data)], dtype=np.uint64)])
        word = mixed((sums[end] - sums[start]) * self.down[start])
        bounds = np.cumsum([len(r) + 1 for r in raw])
        counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        grams = np.zeros(len(word), np.uint64)
        left = np.repeat(first + counts, counts) - np.arange(len(word))  # words from here to the text's end
        for k in range(self.words):
            grams = grams * np.uint64(0xD1342543DE82EF95) + np.uint64(1)
            here = left > k
            grams[here] += np.roll(word, -k)[here] if k else word[here]
        # a run needs all its words; a shorter text has one run from its start
        whole = (left >= self.words) | ((np.repeat(counts, counts) < self.words) & (left == np.repeat(counts, counts)))
        sizes = np.where(counts == 0, 0, np.maximum(1, counts - self.words + 1))
        return mixed(grams[whole]), sizes


def minima(grams: np.ndarray, sizes: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values, one row for each text with grams."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    return np.stack([np.minimum.reduceat(x * a[k] + b[k], starts) for k in range(hashes)], axis=1)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(values), bands), np.uint64)
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        out = mixed(out ^ values[:, r::rows][:, :bands].astype(np.uint64) ^ salt)
    return out.view(np.int64)


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, key: the text's digest, n: how many runs, bands array<long>)."""
    bands, rows = bands_for(threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        grams_of = Grams(words)
        for texts, part in by_piece(batches):
            grams, sizes = grams_of(texts)
            found = np.zeros((0, bands), np.int64)
            if len(grams):
                found = band_keys(minima(grams, sizes, bands * rows), bands, rows)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], ["id", "key", "n", "bands"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    kind = docs.schema[id_column].dataType.simpleString()
    return batched(docs).select(F.col(id_column).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).mapInArrow(run, f"id {kind}, key binary, n long, bands array<long>")


def gram_sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Adds grams (each row's set, sorted) in place of text. Of the rows of one
    key, which have one text, each task gives the first."""
    names = [c for c in rows.columns if c != "text"]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            first = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    first.append(i)
            yield batch.take(pa.array(first, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        grams_of = Grams(words)
        for texts, part in by_piece(firsts(batches)):
            grams, sizes = grams_of(texts)
            sets = [np.unique(g).view(np.int64) for g in np.split(grams, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), list_array(sets, pa.int64(), np.int64)], [*names, "grams"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return batched(rows).mapInArrow(run, f"{schema}, grams array<long>")


def blocked(nodes: DataFrame) -> DataFrame:
    """Adds block: nodes (key, n, bands, comp, ...) in the order of component and
    first band, cut wherever a block is full. Blocks run across partitions, so
    that their number follows from the nodes alone."""
    names = nodes.columns
    least = BLOCK_MEMBERS // BLOCK_NODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = np.maximum(1, batch.column("n").to_numpy() // least)
            ends = at + np.cumsum(weight)
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), own, np.int32)), pa.array(ends - weight), pa.array(weight)], [*names, "own", "begin", "weight"])

    order = ["comp", F.get("bands", F.lit(0)), "key"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    placed = stage_table(nodes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, own int, begin long, weight long"), "placed")
    # one row for each partition
    offsets, at = [], 0
    for own, size in sorted(map(tuple, placed.groupBy("own").agg(F.sum("weight")).collect())):
        offsets.append((own, at))
        at += size
    starts = F.broadcast(placed.sparkSession.createDataFrame(offsets, "own int, offset long"))
    return placed.join(starts, "own").select(*names, F.floor((F.col("offset") + F.col("begin")) / BLOCK_NODES).cast("long").alias("block"))


def shared(lists: tuple[np.ndarray, np.ndarray], n: int, width: int, pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
    """For each (node, partners), how many members the node has in common with
    each partner. lists: members of all nodes and where each node's begin."""
    members, begin = lists
    sizes = np.diff(begin)
    mark = np.zeros(width, bool)
    for node, partners in pairs:
        own = members[begin[node] : begin[node + 1]]
        mark[own] = True
        out = np.zeros(len(partners), np.int64)
        step = max(1, 4_000_000 // max(1, int(sizes[partners].max(initial=1))))
        for at in range(0, len(partners), step):
            some = partners[at : at + step]
            length = sizes[some]
            ends = np.cumsum(length)
            flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[some] - (ends - length), length)
            hits = np.concatenate([[0], np.cumsum(mark[members[flat]])])
            out[at : at + step] = hits[ends] - hits[ends - length]
        mark[own] = False
        yield out


def verify(table: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Links within a block, or between two blocks, as one row for each linked
    node: (key, root: the smallest key it is joined to, links)."""
    keys = table.column("key").to_pylist()
    order = sorted(dict(zip(keys, range(len(keys)), strict=True)).items())
    rows = np.array([i for _, i in order])
    keys = [k for k, _ in order]
    n = len(keys)
    block, copies = (table.column(c).to_numpy()[rows] for c in ("block", "copies"))
    lists = table.column("bands").combine_chunks()
    bands = lists.flatten().to_numpy().reshape(len(table), -1)[rows]
    grams = table.column("grams").combine_chunks()
    values, offsets = grams.values.to_numpy(), grams.offsets.to_numpy().astype(np.int64)
    sizes = (offsets[1:] - offsets[:-1])[rows]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in rows])
    distinct, members = np.unique(values, return_inverse=True)

    near = np.zeros((n, n), bool)
    for column in bands.T:
        by = np.argsort(column, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(column[by])) + 1, [n]])
        for k in np.flatnonzero(np.diff(edges) > 1):
            group = by[edges[k] : edges[k + 1]]
            near[np.ix_(group, group)] = True
    near &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    near = np.triu(near, 1)
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        near &= block[:, None] != block[None, :]

    links, root = np.zeros(n, np.int64), np.arange(n)
    todo = np.flatnonzero(near.any(axis=1))
    partners = [np.flatnonzero(near[i]) for i in todo]
    left, right = [], []
    for i, others, common in zip(todo, partners, shared((members, begin), n, len(distinct), zip(todo, partners, strict=True)), strict=True):
        good = others[common >= threshold * (sizes[i] + sizes[others] - common) - 1e-9]
        links[i] += copies[good].sum()
        links[good] += copies[i]
        left.append(np.full(len(good), i))
        right.append(good)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            before = root.copy()
            np.minimum.at(root, b, root[a])
            np.minimum.at(root, a, root[b])
            root = root[root]
            if (root == before).all():
                break
    linked = np.flatnonzero(links)
    return pa.table({"key": pa.array([keys[i] for i in linked], pa.binary()), "root": pa.array([keys[root[i]] for i in linked], pa.binary()), "links": pa.array(links[linked])})


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each of docs: (id, class_id, n_links, copies)."""
    with scratch() as made:
        marks = stage_table(signatures(docs, id_column, text_column, words, threshold, recall), "marks")
        nodes = stage_table(marks.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "nodes")
        found = stage_table(_links(docs, nodes, id_column, text_column, words, threshold), "links")

        links = found.groupBy(F.col("key").alias("link_key")).agg(F.sum("links").alias("links"))
        classes = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
        whole = nodes.select("key", "rep", "copies").join(classes, F.col("key") == F.col("node"), "left").join(links, F.col("key") == F.col("link_key"), "left")
        whole = stage_table(whole.select("key", "rep", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
        ids = stage_table(whole.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("size")), "class-ids")
        rows, distinct = whole.agg(F.sum("copies"), F.count(F.lit(1))).first()
        named = meet(whole, ids, "root", F.xxhash64("key"), distinct).select("key", "class_id", "copies", "links", F.col("copies").alias("size"))
        named = stage_table(named, "named")
        made.release(marks, named)

    out = meet(marks.filter("n > 0").select("id", "key"), named, "key", F.monotonically_increasing_id(), rows or 0)
    out = out.select("id", "class_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "copies")
    alone = marks.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return out.unionByName(alone).withColumnRenamed("id", id_column)


def _links(docs: DataFrame, nodes: DataFrame, id_column: str, text_column: str, words: int, threshold: float) -> DataFrame:
    """(key, root, links) of the candidates of each block and pair of blocks."""
    # candidates: a star in each bucket, then their components
    slots = nodes.select("key", F.explode("bands").alias("bucket"))
    heads = stage_table(slots.groupBy("bucket").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "heads")
    total = heads.agg(F.sum("size")).first()[0] or 0
    near = components(meet(slots, heads, "bucket", F.xxhash64("key"), total).select(F.col("key").alias("u"), F.col("head").alias("v")))
    member = near.union(near.select("root", "root").distinct())
    at = nodes.join(member, F.col("key") == F.col("node")).select("key", "rep", "copies", "n", "bands", F.col("root").alias("comp"))
    at = stage_table(blocked(at), "blocks")

    # a bucket over several blocks sends its nodes to each pair of them
    places = at.select("key", "block", F.explode("bands").alias("bucket"))
    wide = stage_table(places.groupBy("bucket").agg(F.collect_set("block").alias("blocks"), F.count(F.lit(1)).alias("size")).filter(F.size("blocks") > 1), "wide")
    total = wide.agg(F.sum("size")).first()[0] or 0
    across = meet(places, wide, "bucket", F.xxhash64("key"), total).groupBy(F.col("key").alias("of")).agg(F.any_value("block").alias("own"), F.flatten(F.collect_set("blocks")).alias("blocks"))
    others = F.array_remove(F.array_distinct("blocks"), F.col("own"))
    across = across.select("of", F.transform(others, lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"))).alias("pairs"))
    own = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")))
    at = at.join(across, F.col("key") == F.col("of"), "left").select("key", "rep", "copies", "bands", "block", F.concat(own, F.coalesce("pairs", F.array().cast("array<struct<i:bigint,j:bigint>>"))).alias("pairs"))
    at = stage_table(at, "candidates")

    # the candidates' texts, one for each node
    texts = docs.select(F.col(id_column).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))).alias("text_key"), F.col(text_column).alias("text"))
    with_text = texts.join(small(at), (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("rep")))
    sets = gram_sets(with_text.select("key", "copies", "bands", "block", "pairs", "text"), words)
    sent = sets.select("key", "copies", "bands", "block", "grams", F.inline("pairs"))
    return sent.groupBy("i", "j").applyInArrow(lambda t: verify(t, threshold), "key binary, root binary, links long")
