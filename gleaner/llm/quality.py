"""Quality rules with risk-controlled thresholds.

A few per-document scores (higher is worse) each get a ladder of cutoffs, from
lenient to strict. On labelled documents, each rung of each ladder is tested in
each stratum (language): is the chance of rejecting a good document above the
rule's share of the allowed risk? The test is exact: the binomial probability of
seeing so few rejected among so many good documents if the chance were that
high. Ladders are walked in order and stop at the first rung that isn't
certified (fixed-sequence testing), and the error level is divided by the number
of ladders in all strata (Bonferroni). So with probability 1 - ERROR, no rule
rejects more than its share of good documents in any stratum. Of the certified
rungs, the one with the best balance of bad and good rejected is taken; a
stratum with too few labels certifies none and keeps whatever passes the base.

Everything is DataFrame expressions. Defined results: a null text has no words;
documents with under 20 words or mostly repeated ones fail the base; a null
language is a stratum of its own; labels for one id that contradict each other
count as bad; without any labels only the base decides. Rows that repeat each
get their own result, and other columns of the inputs are ignored. Windows of
eight words are equal if 64-bit hashes of theirs are (within one text; a wrong
match among a million windows has a chance of about 3e-8).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD_GAP, small, stage_table, words_of

#: Share of good documents that all rules together may reject in a stratum, and the chance that a certificate is wrong.
RISK, ERROR = 0.05, 0.05
#: Good documents are that much dearer than bad ones when a certified cutoff is chosen.
GOOD_COST = 5
WINDOW = 8
#: Cutoffs from lenient to strict; a document above the cutoff is rejected.
LADDERS: dict[str, list[float]] = {
    "symbol_rate": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],
    "upper_rate": [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07],
    "shout_rate": [1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeat_rate": [0.28, 0.25, 0.22, 0.19, 0.16, 0.13, 0.1, 0.07, 0.04, 0.02],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
}


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts and the score of each rule, one row for each of docs."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    df = docs.select(F.col(id_column), F.col(stratum).alias("stratum"), *keep, text.alias("t"), words_of(F.col(text_column)).alias("ws"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    df = df.select("*", F.size("ws").cast("long").alias("n_words"), F.transform("ws", lambda x: F.xxhash64(x)).alias("hs"))
    last = F.size("hs") - WINDOW
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("hs", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("gs", grams).drop("hs")
    placed = F.array_sort(F.transform("gs", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("ps", F.when(F.size(F.array_distinct("gs")) < F.size("gs"), placed)).drop("gs")
    starts = F.array_sort(F.transform(F.filter("ps", lambda x, k: F.coalesce(F.get("ps", k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("ps", k + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")),
    )["n"]
    chars = F.length(F.concat_ws("", "ws")).cast("long")
    df = df.select(
        id_column, "stratum", *keep, "n_words", chars.alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("ps").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_shouts"),
        F.size("ls").cast("long").alias("n_lines"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_shouts", "n_words").alias("shout_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
    )


def log_gamma(x: Column) -> Column:
    """Stirling's series after moving x up by eight."""
    z = x + 8
    risen = reduce(lambda a, k: a * (x + k), range(1, 8), x)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(risen)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 if k is above the mean. Added from the
    largest term down. For k below the mean the j-th term is under
    exp(-j * j / (2 * n * p)) of the first, so that what lies ten standard
    deviations further down is lost in the last bits of a double."""
    top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    steps = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 100).cast("int")
    run = F.aggregate(
        F.when((steps > 0) & (k <= n * p), F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * odds * (k - i + 1) / (n - k + i)).alias("term"), (a["sum"] + a["term"] * odds * (k - i + 1) / (n - k + i)).alias("sum")),
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * run["sum"]))


def thresholds(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one column of chosen cutoffs for each rule), for strata with
    any certified cutoff. measured is read once; a handful of rows for each
    stratum and rule remain after the first aggregation."""
    marked = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg((F.min(label) == 1).alias("good"))
    known = measured.filter(~F.col("base_failed")).join(marked, F.col(id_column) == F.col("label_id"))
    rungs = max(map(len, LADDERS.values()))
    exceeded = [F.struct(F.lit(rule).alias("rule"), sum((F.col(rule) > c).cast("int") for c in cuts).alias("over")) for rule, cuts in LADDERS.items()]
    counts = known.select("stratum", "good", F.inline(F.array(*exceeded))).groupBy("stratum", "rule", "over").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    steps = F.array(*[F.struct(F.lit(rule).alias("rule_of"), F.lit(j).alias("rung"), F.lit(c).alias("cutoff"), F.lit(len(cuts) - j).alias("least")) for rule, cuts in LADDERS.items() for j, c in enumerate(cuts)])
    # a rung rejects what exceeds at least `least` cutoffs of its ladder
    ladder = counts.withColumn("step", F.explode(F.filter(steps, lambda s: s["rule_of"] == F.col("rule")))).select("stratum", "rule", "over", "good", "bad", "step.*")
    rejected = ladder.groupBy("stratum", "rule", "rung", "cutoff").agg(F.sum("good").cast("double").alias("n"), F.sum(F.when(F.col("over") >= F.col("least"), F.col("good")).otherwise(0)).cast("double").alias("k"), F.sum(F.when(F.col("over") >= F.col("least"), F.col("bad")).otherwise(0)).alias("bad_k"))
    strata = measured.sparkSession.range(1).select(F.lit(rungs).alias("rungs")).crossJoin(rejected.filter("n > 0").agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))).alias("strata")))
    tested = rejected.filter("n > 0").crossJoin(F.broadcast(strata)).withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(LADDERS)))
    passed = tested.filter(F.col("p") <= error / (F.col("strata") * len(LADDERS))).withColumn("gain", F.col("bad_k") - GOOD_COST * F.col("k")).filter("gain > 0")
    best = passed.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "rung"))).filter("r = 1")
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in LADDERS])


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' measures (and the columns keep) with kept: what passes the base and
    every certified rule of its stratum."""
    measured = stage_table(measures(docs, id_column, text_column, stratum, keep), "quality")
    cuts = small(stage_table(thresholds(measured, labels, id_column), "quality-cuts")).withColumnRenamed("stratum", "cut_stratum")
    judged = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    passes = reduce(lambda a, rule: a & F.coalesce(F.col(rule) <= F.col(f"cut_{rule}"), F.lit(True)), LADDERS, F.lit(True))
    return judged.select(*measured.columns, (~F.col("base_failed") & passes).alias("kept"))


def oracle() -> str:
    """judge() in DuckDB, for tables with unique ids."""
    rates = {"symbol_rate": "n_symbols / word_chars", "upper_rate": "n_upper / word_chars", "shout_rate": "n_shouts / n_words", "repeat_rate": "n_repeat_words / n_words", "dup_line_rate": "n_dup_lines / n_lines"}
    ladder = ", ".join(f"('{rule}', {j}, {c!r}::DOUBLE)" for rule, cuts in LADDERS.items() for j, c in enumerate(cuts))
    risk = RISK / len(LADDERS)
    count = lambda chars: f"length(t) - length(regexp_replace(t, '{chars}', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{WORD_GAP}'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN r USING (doc_id, gram)) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  ({count('[#*$%&|<>]')})::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, ({count(chr(92) + 'p{Lu}')})::BIGINT AS n_upper, ({count('!')})::BIGINT AS n_shouts, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(f"CASE WHEN {e.split(' / ')[1]} > 0 THEN {e} ELSE 0 END AS {k}" for k, e in rates.items())} FROM m),
q AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (UNPIVOT (SELECT lang, good, {", ".join(rates)} FROM b JOIN q USING (doc_id) WHERE NOT base_failed) ON {", ".join(rates)} INTO NAME rule VALUE score),
ladder(rule, rung, cutoff) AS (VALUES {ladder}),
k AS (SELECT lang, rule, rung, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND score > cutoff) AS k, count(*) FILTER (NOT good AND score > cutoff) AS bad_k FROM s JOIN ladder USING (rule) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * {risk!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p FROM k WHERE n > 0),
best AS (SELECT * FROM p WHERE p <= {ERROR!r} / ((SELECT count(DISTINCT coalesce('=' || lang, '')) FROM k WHERE n > 0) * {len(LADDERS)}) AND bad_k - {GOOD_COST} * k > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad_k - {GOOD_COST} * k DESC, rung) = 1),
over AS (SELECT b.doc_id FROM b JOIN best ON b.lang IS NOT DISTINCT FROM best.lang WHERE CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in rates)} END > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_shouts, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM b"""
