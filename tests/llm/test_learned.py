"""Toxicity, quality classifier and the pipeline."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from gleaner.llm import classifier, mixing, toxicity
from gleaner.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_jaccard import brute
from tests.llm.test_rules import expected_measures

INSULTS = ["scum", "moron", "idiot"]


def corpus(n, seed=1):
    """(text, toxic) of random syllables; the toxic have insults strewn in."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(["ta", "re", "on", "li", "ne", "so"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 220))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def network():
    texts, labels = zip(*corpus(240), strict=True)
    return toxicity.train(list(texts), np.array(labels), steps=200)


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network.start()
    for name, value in vars(net).items():
        setattr(net, name, value.astype(float))
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(9)]
    at, y = rng.integers(0, 10, (4, 6)), np.array([0.0, 1, 1, 0])
    at[:, 0] = 3

    def loss():
        x, parts = net.inputs(words)
        table, keep = net.project(x).astype(float), []
        logits = net.read(table, at, 9, keep)
        return (np.logaddexp(0, logits) - y * logits).sum(), (at, x, table, keep, 1 / (1 + np.exp(-logits)) - y, parts)

    grads = net.backward(*loss()[1])
    for name, value in vars(net).items():
        grad = grads[name]
        if isinstance(grad, tuple):
            full = np.zeros_like(value)
            np.add.at(full, *grad)
            where = (int(grad[0][0]), 1)
        else:
            full, where = grad, (0,) * value.ndim
        old = value[where]
        value[where] = old + 1e-3
        up = loss()[0]
        value[where] = old - 1e-3
        down = loss()[0]
        value[where] = old
        assert full[where] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-5), name


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 112, 113, 500])
def test_windows_overlap_and_reach_the_end(n):
    at, count = toxicity.windows_of(np.array([3, n]), n + 3)
    own = at[count[0] :]
    assert len(own) == count[1] and set(own.ravel()) - {n + 3} == set(range(3, n + 3))
    starts = own[:, 0] if n else []
    assert all(b - a == toxicity.STRIDE < toxicity.LENGTH for a, b in zip(starts, starts[1:], strict=False))


def test_half_a_window_lies_whole_in_some_window():
    at, count = toxicity.windows_of(np.array([300]), 300)
    passages = [range(b, b + toxicity.LENGTH // 2) for b in range(300 - toxicity.LENGTH // 2 + 1)]
    assert all(any(set(p) <= set(w) for w in at) for p in passages)


def test_learns_and_finds_a_word_anywhere(network):
    texts, labels = zip(*corpus(120, 2), strict=True)
    found = toxicity.Scorer(network).scores(list(texts)) >= 0.7
    assert (found == np.array(labels)).mean() > 0.95
    clean = [t for t, y in corpus(60, 3) if not y]
    long = " ".join(clean)
    assert toxicity.Scorer(network).scores([long + " scum moron idiot " + long])[0] > 0.7
    few = toxicity.Scorer(network, kept=50)  # remembers little: the same scores
    assert np.allclose(few.scores(list(texts[:20])), toxicity.Scorer(network).scores(list(texts[:20])), atol=1e-5)


def test_score_edge_rows(spark, network):
    rows = [(1, None, 0.5), (1, None, 0.5), (2, "", 0.1), (None, "moron scum idiot", 0.0), (3, "ta " * 3000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = toxicity.score(docs, network).collect()
    assert sorted(r.score for r in out)[:3] == [0, 0, 0] and len(out) == 5
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, F.lit(True)) is None
    assert toxicity.score(docs.limit(0), network).count() == 0


def plain_score(net, text):
    """The worst window's probability, word by word in plain loops."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall(r"\w+", (text or "").lower())
    vectors = []
    for w in words:
        marked = f"\x02{w}\x03"
        runs = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        chars = sum(net.runs[toxicity_bucket(r)].astype(float) for r in runs) / np.sqrt(len(runs))
        vectors.append(np.concatenate([net.words[zlib.crc32(w.encode()) % toxicity.WORD_BUCKETS], chars]))
    best, start = 0.0, 0
    while words:
        window, states = vectors[start : start + toxicity.LENGTH], []
        for side, steps in ((0, window), (1, window[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for x in steps:
                gates, own = x @ net.inward[side] + net.bias[side], h @ net.inner[side]
                z, r, n = (slice(k * toxicity.HIDDEN, (k + 1) * toxicity.HIDDEN) for k in range(3))
                update, reset = sigmoid(gates[z] + own[z]), sigmoid(gates[r] + own[r])
                h = (1 - update) * np.tanh(gates[n] + reset * own[n]) + update * h
                out.append(h)
            states.append(out if side == 0 else out[::-1])
        both = np.array([np.concatenate(pair) for pair in zip(*states, strict=True)])
        look = np.exp(both @ net.look - (both @ net.look).max())
        best = max(best, sigmoid((look / look.sum()) @ both @ net.out + net.shift[0]))
        if start + toxicity.LENGTH >= len(words):
            break
        start += toxicity.STRIDE
    return best


def toxicity_bucket(run):
    """The bucket of one run of characters, number by number."""
    most, code = 1 << 64, len(run)
    for k, ch in enumerate(run):
        code = (code * 0x9E3779B97F4A7C15 % most) ^ (ord(ch) + k + 1)
    code = (code ^ (code >> 29)) * 0xBF58476D1CE4E5B9 % most
    return (code >> 40) % toxicity.RUN_BUCKETS


def test_scores_are_those_of_plain_loops(spark, network):
    texts = [t for t, _ in corpus(12, 21)] + [None, "", "one", "Scum!", "é moron " * 70, " ".join(["ta"] * 96 + ["idiot"])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, y int, label_id string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, network).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_score(network, t) for t in texts], abs=2e-4)


def test_sample_is_bounded_and_takes_long_texts(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(i, f"text {i}", 0, "x") for i in range(40)] + [(1, "text 1", 0, "x")] * 300 + [(2, f"other {i}", 0, "x") for i in range(300)] + [(50, long, 1, "y"), (51, None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, label_id string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert len(texts) == len(y) == 39 + 301 + 2 and texts.count("text 1") == 1 and "" in texts
    (slices,) = (t for t in texts if t.startswith("word0 "))
    assert toxicity.TRAIN_CHARS <= len(slices) < toxicity.TRAIN_CHARS + 20 and "word39999" in slices and "word2000" in slices
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 20)
    monkeypatch.setattr(toxicity, "TRAIN_CLEAN", 20)
    assert len(toxicity.sample(docs, labels, F.lit(True), "doc_id", "text", "toxic")[0]) <= 40
    monkeypatch.setattr(toxicity, "TRAIN_TOTAL", 100)
    assert sum(map(len, toxicity.sample(docs, labels, F.lit(True), "doc_id", "text", "toxic")[0])) <= 100
    assert toxicity.sample(docs.limit(0), labels, F.lit(True), "doc_id", "text", "toxic")[0] == []


def test_neighbour_sums_count_the_corpus(spark):
    texts = ["a b a c", None, "", "A-7 b", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.bucket: np.array(r[1:]) for r in classifier.neighbour_sums(docs).collect()}
    want = {}
    plus, minus = classifier.index_vectors()
    for t in texts:
        buckets = list(map(classifier.bucket_of, classifier._TOKENS(t or "")))
        for i, b in enumerate(buckets):
            for j in range(max(0, i - 2), min(len(buckets), i + 3)):
                if i != j:
                    row = want.setdefault(b, np.zeros(classifier.DIM))
                    row[plus[buckets[j]]] += 1
                    row[minus[buckets[j]]] -= 1
    want = {b: v for b, v in want.items() if v.any()}
    assert got.keys() == want.keys() and all((got[b] == want[b]).all() for b in want)


def plain_features(text, table):
    """What a text pools to, token by token."""
    buckets = [classifier.bucket_of(t) for t in classifier._TOKENS(text or "")]
    v = [table[b].astype(float) for b in buckets]
    n = len(v)
    if not n:
        return np.zeros(classifier.FEATURES)
    mean = sum(v) / n
    spread = np.sqrt(np.maximum(sum(x * x for x in v) / n - mean * mean, 0))
    close = sum(float(a @ b) for a, b in zip(v, v[1:], strict=False)) / n
    focus = np.sqrt(sum(buckets.count(b) ** 2 for b in set(buckets))) / n
    return np.concatenate([mean, spread, [close, focus, np.log(1 + n)]])


def test_classifier_scores_are_those_of_plain_loops(spark):
    rng = random.Random(31)
    rows = [(i, " ".join(("%%% " if i % 4 == 0 else "") + rng.choice(["Ta", "re", "ON", "li7", "né", "so-so"]) for _ in range(rng.randrange(1, 60)))) for i in range(120)] + [(200, None), (201, ""), (7, "x"), (None, "on li")]
    docs = spark.createDataFrame([(i, t, 0.5, "l") for i, t in rows], "doc_id long, text string, y double, label_id string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int")
    table = classifier.vectors(classifier.neighbour_sums(docs))
    featured = classifier.features(docs, table)
    by_row = {(r.doc_id, tuple(r.features)) for r in featured.collect()}
    want = [(i, plain_features(t, table)) for i, t in rows]
    assert all(any(i == j and np.allclose(x, y, atol=2e-3) for j, y in by_row) for i, x in want)
    learn, calibrate = F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1
    net = classifier.fit(featured, labels, learn, calibrate)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in classifier.classify(docs, labels, learn, calibrate).collect()))
    plain = []
    for i, x in want:
        hidden = [np.tanh(sum((x[k] - net.mean[k]) / net.spread[k] * net.a[k, j] for k in range(len(x))) + net.a0[j]) for j in range(classifier.HIDDEN)]
        plain.append((i is None, i or 0, 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.b, strict=True)) + net.b0) / net.temperature))))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(plain)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(plain)], abs=5e-3)


def test_classifier_held_out(spark):
    rng = random.Random(4)
    rows = []
    for i, (text, _) in enumerate(corpus(700, 5)):
        junk = i % 5 == 0
        rows.append((i, "".join(w + rng.choice(["%%% ", "### "]) for w in text.split()) if junk else text, int(not junk)))
    rows += [(9000, None, 1), (9001, "", 0), (9000, None, 1)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, features double").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 9000], "doc_id long, quality int")
    scored = classifier.classify(docs, labels, (F.col("doc_id") % 7) != 0, (F.col("doc_id") % 7) == 1).collect()
    held = {r.doc_id: r.score for r in scored if r.doc_id < 9000 and r.doc_id % 7 == 0}
    assert np.mean([(held[i] >= 0.3) == bool(y) for i, _, y in rows if i in held]) > 0.97
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in classifier.classify(docs, labels.limit(0), F.lit(True), F.lit(False)).collect()} == {0.5}


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(7)
    docs, labels = [], []
    for i, (text, toxic) in enumerate(corpus(300, 8)):
        docs.append((i, text, rng.choice(["en", "de", None]), f"s{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    for i in range(300, 340):  # copies and near copies
        words = docs[rng.randrange(300)][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "other"
        docs.append((i, " ".join(words), "en", "s0", 1))
    docs += [(400, None, "en", "s1", 0), (401, "too short", None, None, 9), (402, "again and again the very same nine words here " * 30, "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        steps.append({r.doc_id: r for r in kept.collect()})
    first = {d: t for d, t, *_ in docs if not expected_measures(t)[-1]}
    assert steps[0].keys() == first.keys()
    network = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").filter(F.col("doc_id").isin(list(first))), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    order = list(first)
    clean = [d for d, s in zip(order, toxicity.Scorer(network).scores([first[d] for d in order]), strict=True) if s < 0.7]
    assert steps[1].keys() == set(clean)
    classes = brute([(d, first[d]) for d in clean])
    assert steps[2].keys() == {d for d, c, _ in classes if d == c}
    drawn = {r.doc_id for r in mixing.mix(spark.createDataFrame([tuple(r) for r in steps[2].values()], "doc_id long, text string, lang string, source string, n_chars long"), budget=corpus_pipeline.BUDGET).filter("sampled").collect()}
    assert steps[3].keys() == drawn and 0.5 < len(drawn) / len(steps[2]) <= 1
    library = Tokenizer.from_file(tokenizer_path())
    assert {d: r.n_tokens for d, r in steps[4].items()} == {d: len(library.encode(first[d], add_special_tokens=False).ids) for d in drawn}


def test_pipeline_judges_rows_not_ids(spark, tmp_path, network, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(11)
    fresh = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    stage = lambda name, rows: dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema).repartition(3), str(tmp_path))
    kept = lambda name, rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in stage(name, rows).collect())
    want = lambda *rows: sorted((i is None, i or 0, t) for i, t in rows)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    a, b, c, d = (fresh() for _ in range(4))
    rows = [(None, a), (None, "too short"), (None, None), (1, b), (1, "too short"), (2, c), (2, c)]
    assert kept("quality_rules", rows) == want((None, a), (1, b), (2, c), (2, c))

    monkeypatch.setattr(toxicity, "fit", lambda *_: network)
    texts, labels = zip(*corpus(40, 12), strict=True)
    found = toxicity.Scorer(network).scores(list(texts)) >= 0.7
    bad, good = ([t for t, f in zip(texts, found, strict=True) if f is np.bool_(x)] for x in (True, False))
    assert kept("toxicity", [(1, bad[0]), (1, good[0]), (None, bad[1]), (None, good[1])]) == want((1, good[0]), (None, good[1]))

    near = f"{a} other"
    rows = [(7, a), (7, a), (7, b), (None, near), (None, c), (None, c), (8, near), (9, d), (9, f"{d} other")]
    out = kept("ngram_jaccard", rows)
    assert [x for x in out if x[2] not in (d, f"{d} other")] == want((7, a), (7, b), (None, c))
    assert sum(x[2] in (d, f"{d} other") for x in out) == 1

    for ids in (None, 5):
        drawn = stage("mixing", [(ids, fresh()) for _ in range(200)]).count()
        assert 120 < drawn < 195
