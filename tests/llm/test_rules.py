"""Quality rules, mixing, licenses and URL filters against plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
from gleaner.llm import licenses, mixing, quality, urls
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d e f g h " * 5, "x\n\nx\ny\nx", "É! $# **", "w" * 5000, "the same words over and over again now " * 40]


def expected_measures(text):
    words = WORDS.findall(text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def documents(spark, rows, more="n_words string, stratum int, rule string"):
    extra = len(more.split(","))
    return spark.createDataFrame([(*r, *["1" if "string" in k else 1 for k in more.split(",")]) for r in rows], f"doc_id long, text string, lang string, source string, {more}").repartition(3) if extra else None


def test_measures(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts)]
    out = quality.measures(documents(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in out) == Counter(map(expected_measures, texts))


@pytest.mark.parametrize(("n", "p"), [(10, 0.3), (700, 0.01), (5000, 0.02), (100_000, 0.01), (10_000_000, 0.01)])
def test_binomial_tail(spark, n, p):
    ks = sorted({0, 1, int(n * p / 3), int(n * p * 0.8), int(n * p)})
    rows = spark.createDataFrame([(float(k), float(n)) for k in ks], "k double, n double")
    got = {r.k: r.t for r in rows.select("k", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()}
    for k in ks:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got[k] == pytest.approx(exact, rel=1e-6)


def plain_cutoffs(rows, labels, risk=quality.RISK, error=quality.ERROR):
    """The chosen cutoffs by stratum and rule, all rungs tested in plain loops."""
    rates = {}
    for doc, text, lang, _ in rows:
        words, chars, symbols, dup, repeated, failed = expected_measures(text)
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        rate = lambda a, b: a / b if b else 0.0
        if not failed and doc in labels:
            upper, shouts = sum(unicodedata.category(c) == "Lu" for c in text), text.count("!")
            rates.setdefault(lang, []).append((labels[doc], {"symbol_rate": rate(symbols, chars), "upper_rate": rate(upper, chars), "shout_rate": rate(shouts, words), "repeat_rate": rate(repeated, words), "dup_line_rate": rate(dup, len(lines))}))
    strata = [s for s, found in rates.items() if any(good for good, _ in found)]
    out = {}
    for s in strata:
        n = sum(good for good, _ in rates[s])
        for rule, cuts in quality.LADDERS.items():
            best = None
            for cut in cuts:
                k = sum(good and r[rule] > cut for good, r in rates[s])
                p = risk / len(quality.LADDERS)
                tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k <= n * p else 1
                gain = sum(not good and r[rule] > cut for good, r in rates[s]) - quality.GOOD_COST * k
                if tail <= error / (len(strata) * len(quality.LADDERS)) and gain > 0 and (best is None or gain > best[0]):
                    best = (gain, cut)
            if best:
                out[s, rule] = best[1]
    return out


def test_thresholds_keep_good_documents(spark):
    """Three strata large enough to certify cutoffs, one of them null, and one that isn't."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    spoil = {"en": lambda w: w + "%%", "de": str.upper, None: lambda w: w + "!"}
    rows, labels = [], {}
    for i in range(4500):
        lang, bad = ["en", "de", None][i % 3] if i < 4350 else "fr", i % 10 == 0
        odd = rng.random() < 0.0015  # a few good documents look bad
        rows.append((i, " ".join(spoil.get(lang, str.upper)(word()) if bad or odd else word() for _ in range(24)), lang, "s"))
        labels[i] = not bad
    rows += [(9000, None, "en", None), (9001, rows[11][1], "xx", None)]
    table = spark.createDataFrame([*((i, int(y), 0) for i, y in labels.items()), (5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    want = plain_cutoffs(rows, labels)
    assert {s for s, _ in want} == {"en", "de", None}
    cuts = quality.thresholds(quality.measures(documents(spark, rows)), table).collect()
    assert {(r.stratum, rule): r[f"cut_{rule}"] for r in cuts for rule in quality.LADDERS if r[f"cut_{rule}"] is not None} == want
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows), table).collect()}
    assert not any(out[i].kept for i in range(0, 4350, 10)) and sum(not out[i].kept for i in range(4350) if i % 10) < 30
    assert all(out[i].kept for i in range(4350, 4500))  # a stratum with too few labels rejects by the base alone
    assert not out[9000].kept and out[9001].kept
    none = quality.judge(documents(spark, rows[:50]), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.filter("kept").count() == 50
    assert quality.judge(documents(spark, rows).limit(0), table).count() == 0


def test_raking_meets_targets_and_budget(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(s, lang, t, rng.randrange(50, 5000)) for s in ["a", "b", None, "c"] for lang in ["en", "de", None] for t in ["prose", "legal"]], "source string, lang string, topic string, tokens long")
    goals = {"source": 0.5, "lang": {"en": 0.5, "de": 0.3}, "topic": 0.7}
    one = {(r.source, r.lang, r.topic): r for r in mixing.rake(cells, targets=goals, rounds=20, budget=0.4).collect()}
    many = {(r.source, r.lang, r.topic): r for r in mixing.rake(cells, targets=goals, rounds=2, budget=0.4, one_task=False).collect()}
    two = {(r.source, r.lang, r.topic): r for r in mixing.rake(cells, targets=goals, rounds=2, budget=0.4, one_task=True).collect()}
    assert all(many[k].p == pytest.approx(two[k].p) and many[k].weight == pytest.approx(two[k].weight) for k in two)
    tokens = {k: r.tokens for k, r in one.items()}
    total = sum(tokens.values())
    by = lambda d, v: sum(x for k, x in v.items() for name in [k[d]] if name == "en")
    weight = {k: r.weight for k, r in one.items()}
    none_share = sum(t for k, t in tokens.items() if k[1] is None) / total
    assert by(1, weight) == pytest.approx(0.5 / (0.8 + none_share), rel=1e-6)
    roots = {s: math.sqrt(sum(t for k, t in tokens.items() if k[0] == s) / total) for s in ("a", "b", None, "c")}
    for s in roots:
        assert sum(w for k, w in weight.items() if k[0] == s) == pytest.approx(roots[s] / sum(roots.values()), rel=1e-4)
    assert sum(r.tokens * r.p for r in one.values()) == pytest.approx(0.4 * total, rel=1e-6)
    everything = mixing.rake(cells, targets=goals, budget=1.5).collect()
    assert all(r.p == 1 for r in everything)


def test_raking_goes_on_until_the_targets_hold(spark):
    # sources that are almost monolingual, one of them hot
    rows = [(f"s{s}", f"l{k}", t, (100 if s else 10_000) * (2997 if s % 4 == k else 1)) for s in range(6) for k in range(4) for t in ("prose", "legal")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = {"source": 0.5, "lang": {"l0": 0.4, "l1": 0.2, "l2": 0.2, "l3": 0.2}, "topic": 0.7}
    out = mixing.rake(cells, targets=goals, budget=0.9).collect()
    total = sum(r[3] for r in rows)
    roots = {s: math.sqrt(sum(r[3] for r in rows if r[0] == s) / total) for s in {r[0] for r in rows}}
    for s, root in roots.items():
        assert sum(r.weight for r in out if r.source == s) == pytest.approx(root / sum(roots.values()), rel=2e-4)
    for k, share in goals["lang"].items():
        assert sum(r.weight for r in out if r.lang == k) == pytest.approx(share, rel=2e-4)
    assert sum(r.tokens * r.p for r in out) == pytest.approx(0.9 * total, rel=1e-5)
    # targets that no weights meet are reported
    lone = spark.createDataFrame([("a", "l0", "prose", 900), ("b", "l1", "prose", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="target is missed"):
        mixing.rake(lone, targets=goals).collect()


def test_mix_odd_rows(spark):
    rows = [(i, t, "en" if i % 2 else None, None) for i, t in enumerate(ODD)] + [(None, "x y z", "en", "s"), (4, ODD[4], "en", None)]
    out = mixing.mix(documents(spark, rows, "topic string, tokens string, p string, each string"), budget=0.5).collect()
    assert len(out) == len(rows)
    assert all(r.p == 0 and not r.sampled for r in out if r.n_tokens == 0)
    assert len({r.sampled for r in out if r.doc_id == 4 and r.lang == "en"}) <= 1
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0
    named = mixing.mix(documents(spark, rows, "topic string, tokens string"), topic=F.concat(F.lit("t"), F.length("text") % 2)).collect()
    assert {r.topic for r in named} == {None, "t0", "t1"} and len(named) == len(rows)


def test_license_scan_against_all_pairs(spark):
    rng = random.Random(4)
    pool = licenses.words_in(" ".join(t for _, t in licenses.TEMPLATES))
    texts = [*ODD, "Under the MIT License, under the mit LICENSE!", "x" * 9 + " CC-BY-NC", "apache license version 2 " * 3]
    for _ in range(80):
        base = licenses.words_in(rng.choice(licenses.TEMPLATES)[1])
        kept = [w for w in base if rng.random() < 0.9]
        noise = [rng.choice(pool) if rng.random() < 0.3 else b"zz%d" % rng.randrange(99) for _ in range(rng.randrange(150))]
        at = rng.randrange(len(noise) + 1)
        texts.append(b" ".join(noise[:at] + kept + noise[at:]).decode())
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (None, texts[10], None, None)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), tuple(map(tuple, r.matches))) for r in licenses.scan(documents(spark, rows, "id string, labels string, score string")).collect())
    want = Counter()
    for doc, text, *_ in rows:
        words = licenses.words_in(text or "")
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        found = []
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            own, half = set(licenses.words_in(template)), licenses.half_for(template)
            assert half >= len(licenses.words_in(template))
            for start in range(0, max(1, len(words) - half), half) if words else ():
                block = set(words[start : start + 2 * half])
                if len(own & block) >= 0.8 * len(own) - 1e-9:
                    found.append((start, k, len(own & block) / len(own)))
        found.sort()
        base = {label for _, label in places}
        labels = base | {licenses.TEMPLATES[k][0] for _, k, _ in found}
        at = [i for i, _ in places]
        want[doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1.0 if base else max((c for *_, c in found), default=0.0), 9), tuple(found)] += 1
    assert got == want


def test_license_templates_of_any_length(spark):
    """A whole text of 500 words is found in a longer one; thousands of phrases cost one pass."""
    whole = " ".join(f"term{i}" for i in range(500))
    noise = " ".join(f"n{i}" for i in range(900))
    near = " ".join(w for i, w in enumerate(whole.split()) if i % 7)
    docs = documents(spark, [(1, f"{noise} {whole} {noise}", "en", "s"), (2, f"{noise} {near} {noise}", "en", "s"), (3, whole[: len(whole) // 2], "en", "s"), (4, noise * 20, "en", "s")])
    phrases = {f"phrase number {i}": f"p{i}" for i in range(5000)} | {"n5 n6": "five", "n5 n6 n7": "long"}
    out = {r.doc_id: r for r in licenses.scan(docs, [("whole", whole), ("short", "n3 n4 n5")], phrases).collect()}
    assert {i: r.labels for i, r in out.items()} == {1: "five,long,short,whole", 2: "five,long,short,whole", 3: "", 4: "five,long,short"}
    assert out[1].n_base == 4 and out[1].first_word == 5 and out[4].n_base == 40


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_urls_against_every_rule(spark, monkeypatch):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "e.com", "", "org.", ".org", "é.com", "x\x01com", "x", "x\x02com", "a.x\x024com"]
    paths = ["", "/", "/en/", "/en/1", "/en/12/x", "/fr/", "/fr/é"]
    rules = [urls.Rule(rng.choice(["allow", "block"]), h, p, rng.random() < 0.6) for h in hosts if h for p in paths for _ in range(2) if rng.random() < 0.5]
    addresses = [None, "", "no scheme", "http://", "HTTP://Example.ORG/EN/", "http://a.example.org?x=/en/1", "x://h://y"] + [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#t', 'z'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "k", "r") for i, u in enumerate(addresses)], "page_id long, url string, key string, rule string").repartition(4)
    columns = ("page_id", "host", "path", "rule", "own_rule", "verdict")
    got = Counter(tuple(r[c] for c in columns) for r in urls.judge(pages, rules).collect())
    want = Counter()
    for i, u in enumerate(addresses):
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups() if u and "://" in u else ("", "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = max((r for r in rules if host and fits(r, host, path)), key=lambda r: r.strength, default=None)
        name = best and best.host + best.path
        want[i if i % 9 else None, host, path, name if best and best.base else None, name if best and not best.base else None, best.action if best else "allow"] += 1
    assert got == want
    table = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string, base boolean")
    for size in (400, 25):  # one range, and many
        many = urls.ranged(urls.parts_of(pages, "page_id", "url"), table, "bigint", size).withColumnRenamed("id", "page_id")
        assert Counter(tuple(r[c] for c in columns) for r in many.collect()) == want
    assert urls.ranged(urls.parts_of(pages.limit(0), "page_id", "url"), table, "bigint").count() == 0
    monkeypatch.setattr(urls, "MOST_RULES", 5)
    assert Counter(tuple(r[c] for c in columns) for r in urls.judge(pages, rules).collect()) == want
    assert Counter(tuple(r[c] for c in columns) for r in urls.judge(pages, table).collect()) == want
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_many_rules_under_one_host_are_nested_once():
    rules = [urls.Rule("block", "com", f"/{i:05}") for i in range(20_000)] + [urls.Rule("allow", "com", "/000")]
    sweep, made = urls.Sweep(rules), []
    init = urls.Paths.__init__
    urls.Paths.__init__ = lambda self, some: (made.append(len(some)), init(self, some))[1]
    try:
        found = [sweep.at(urls.host_key(h), "/00077x") for h in sorted((f"h{i}.com" for i in range(500)), key=urls.host_key)]
    finally:
        urls.Paths.__init__ = init
    assert made == [20_001] and {r.path for r in found} == {"/00077"}


def test_sql_of_odd_rows(spark):
    """The oracles agree with the operators on texts that the tables lack."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(ODD)]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    docs, labels = documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.kept) for r in quality.judge(docs, labels).collect()}
    assert {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_words, n_repeat_words, kept FROM ({quality.oracle()})").fetchall()} == got
    drawn = {r.doc_id: (r.topic, round(r.p, 6), r.sampled) for r in mixing.mix(docs).collect()}
    assert {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, topic, p, sampled FROM ({mixing.oracle()})").fetchall()} == drawn
