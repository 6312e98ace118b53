import os
import random
from itertools import combinations

import numpy as np
import pytest
from gleaner.llm import common, graphs, jaccard


def sets_of(text):
    words = (text or "").lower().replace("\x1c", "\x1c").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Classes and links over all pairs of rows."""
    sets = [sets_of(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and (rows[i][1] == rows[j][1] or 5 * len(a & b) >= 4 * len(a | b)):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, least.get(find(i)) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(docs).collect()), key=str)


def test_bands_reach_recall():
    bands, rows = jaccard.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    assert jaccard.bands_for(0.5, 0.9, 64)[1] >= 2


def test_gram_hashes_are_those_of_the_words():
    grams = jaccard.Grams()
    texts = ["a b c d e f", "", "A  b\tc\nd e f", "x y", " \n ", "b c d e f"]
    values, sizes = grams(texts)
    assert list(sizes) == [2, 0, 2, 1, 0, 1]
    first, _, third, short, _, last = np.split(values, np.cumsum(sizes)[:-1])
    assert (first == third).all() and last[0] == first[1] and short[0] not in first


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two"), (5, "one two"), (5, "one two"), (None, "a lone null id text"), (None, "one two")]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows.append((999, " ".join(rng.choice(vocabulary) for _ in range(30_000))))
    assert result(spark, rows) == brute(rows)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)  # the same over many blocks, every key of three rows being hot
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert result(spark, rows) == brute(rows)


def test_components_with_hot_centres(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


def test_stage_tables_that_nothing_reads_are_deleted(spark):
    with common.scratch() as made:
        a, b = (common.stage_table(spark.range(3), t) for t in "ab")
        made.release(b)
    assert not os.path.exists(a.stage_path) and b.count() == 3


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_no_link_of_a_whole_table_is_lost(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    sets = {r.doc_id: sets_of(r.text) for r in docs.select("doc_id", "text").collect()}
    by_run = {}
    for doc, runs in sets.items():
        for run in runs:
            by_run.setdefault(run, []).append(doc)
    shared = {}
    for of in by_run.values():
        for pair in combinations(sorted(of), 2):
            shared[pair] = shared.get(pair, 0) + 1
    links = dict.fromkeys(sets, 0)
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    assert got == links and sum(links.values()) > 100


def test_empty(spark):
    assert result(spark, [(1, "")]) == [(1, 1, 0)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(docs).count() == 0
