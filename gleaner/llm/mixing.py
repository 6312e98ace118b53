"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. The cells'
token weights are raked: scaled in turn so that their sums by source, by
language and by topic meet the targets, until all hold together. A document's
weight for each token is its cell's raked weight over its cell's tokens. Each
document is then drawn on its own with a probability in proportion to that
weight, calibrated so that the expected number of tokens is the budget; where
this would pass 1 the document is certain and the excess goes to the others
(residual then tells how often a certain document should be repeated so that
the targets hold exactly). Rounds go on until every sum is within TOLERANCE of
its target; where they stop falling towards it (the targets contradict each other
on the cells there are) or MOST_ROUNDS are over, a warning tells what is left.

Everything is DataFrame expressions. Draws depend on the id alone: repeated rows
are drawn together and a rerun draws the same rows. Defined results: null
sources and languages are values of their own; documents without words have
weight 0 and are never drawn; a budget of all tokens or more draws every document
with words; no rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, scratch, small, stage_table, words_of

DIMENSIONS = ("source", "lang", "topic")
#: For each dimension, weights of values (what isn't listed weighs its own share), or the power to which shares are raised.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": 0.7}
ROUNDS, FILLS, BUDGET = 12, 8, 0.5
#: Raking goes on after ROUNDS until no sum is off its target by more than that share of it; it gives up after so many
#: rounds. Share of all tokens that the draws may be short of the budget.
TOLERANCE, MOST_ROUNDS, SHORT = 1e-4, 1000, 1e-9


def topic_of(text: Column) -> Column:
    """A stand-in for a topic column where the corpus has none: fixed rules over
    the whole text, in order."""
    low = F.lower(text)
    return (
        F.when(low.contains("licens") | low.contains("copyright") | low.contains("rights reserved"), "legal")
        .when(text.rlike(r"[0-9A-Za-z]@[0-9A-Za-z]|\([0-9]{3}\) [0-9]{3}"), "contact")
        .when(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) * 50 > F.length(text), "markup")
        .otherwise("prose")
    )


def draw_of(id_column: str) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48)


def summed(cells: DataFrame, by: tuple[str, ...], one_task: bool, **values: Column) -> DataFrame:
    """cells with sums of values over the rows that share `by`. As a join, the
    result is written at once: each step reads the one before twice, so plans
    that wait would double with every step."""
    if one_task:
        return cells.withColumns({name: F.sum(value).over(Window.partitionBy(*by)) for name, value in values.items()})
    sums = cells.groupBy(*[F.col(c).alias(f"{c}_of") for c in by]).agg(*[F.sum(value).alias(name) for name, value in values.items()])
    if not by:
        return stage_table(cells.crossJoin(F.broadcast(sums)), "sums")
    match = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
    return stage_table(cells.join(sums, match, "left").drop(*[f"{c}_of" for c in by]), "sums")


def missed(df: DataFrame, dimensions: tuple[str, ...]) -> float:
    """The largest share by which a sum of weights is off its target."""
    sums = [df.groupBy(d).agg(F.sum("weight").alias("now"), F.max(f"{d}_goal").alias("goal")).select("now", "goal") for d in dimensions]
    return reduce(DataFrame.union, sums).filter("goal > 0").agg(F.max(F.abs(F.col("now") / F.col("goal") - 1))).first()[0] or 0.0


def rake(cells: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict = TARGETS, rounds: int | None = None, budget: float = BUDGET, one_task: bool | None = None) -> DataFrame:
    """cells (dimensions, tokens > 0) with weight (sums to 1) and p, the chance
    of a draw. Up to BROADCAST_ROWS cells the rounds run in one task without a
    shuffle; beyond, as aggregations and joins. rounds: exactly so many; None:
    ROUNDS, and more until the targets are met."""
    if one_task is None:
        one_task = len(cells.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    df = cells.coalesce(1) if one_task else cells
    df = summed(df, (), one_task, all_tokens=F.col("tokens"))
    for d in dimensions:
        df = summed(df, (d,), one_task, **{f"{d}_tokens": F.col("tokens")})
        share = F.col(f"{d}_tokens") / F.col("all_tokens")
        goal = targets[d]
        if isinstance(goal, dict):
            for value, weight in goal.items():
                share = F.when(F.col(d) == value, F.lit(float(weight))).otherwise(share)
        else:
            share = F.pow(share, F.lit(float(goal)))
        # each value's weight, spread over its cells by their tokens
        df = df.withColumn(f"{d}_goal", share)
        df = summed(df, (), one_task, goals=F.col(f"{d}_goal") * F.col("tokens") / F.col(f"{d}_tokens"))
        df = df.withColumn(f"{d}_goal", F.col(f"{d}_goal") / F.col("goals")).drop("goals", f"{d}_tokens")
    df = df.withColumn("weight", F.col("tokens") / F.col("all_tokens"))

    def settled(df: DataFrame, tag: str) -> DataFrame:
        df = stage_table(df, tag)
        return df.coalesce(1) if one_task else df

    last = float("inf")
    for step in range(MOST_ROUNDS if rounds is None else rounds):
        for d in dimensions:
            df = summed(df, (d,), one_task, now=F.col("weight")).withColumn("weight", F.col("weight") * F.col(f"{d}_goal") / F.col("now")).drop("now")
        if step % 4 == 3:
            df = settled(df, "rake")
            if rounds is None and step + 1 >= ROUNDS:
                off = missed(df, dimensions)
                if off <= TOLERANCE:
                    break
                if off > 0.999 * last or step + 1 >= MOST_ROUNDS:
                    warnings.warn(f"raking: a target is missed by {off:.2g} of itself after {step + 1} rounds", stacklevel=2)
                    break
                last = off
    wanted = F.col("all_tokens") * budget
    df = df.withColumn("each", F.col("weight") / F.col("tokens")).withColumn("scale", wanted)
    p = F.least(F.lit(1.0), F.col("each") * F.col("scale"))
    last = float("inf")
    while True:  # each fill makes a cell certain, or is the last
        for _ in range(FILLS):
            certain = F.col("each") * F.col("scale") >= 1
            df = summed(df, (), one_task, sure=F.when(certain, F.col("tokens")).otherwise(0), open=F.when(certain, F.lit(0.0)).otherwise(F.col("weight")))
            df = df.withColumn("scale", F.when(F.col("open") > 0, F.greatest(F.col("scale"), (wanted - F.col("sure")) / F.col("open"))).otherwise(F.col("scale"))).drop("sure", "open")
        df = settled(df, "fill")
        short = df.agg(F.max(F.least(F.lit(1.0), F.lit(budget)) * F.col("all_tokens")) - F.sum(p * F.col("tokens")), F.max("all_tokens")).first()
        if short[0] is None or short[0] <= SHORT * short[1]:
            break
        if short[0] >= last:
            warnings.warn(f"mixing: {short[0]:.4g} of the budget's tokens can't be drawn", stacklevel=2)
            break
        last = short[0]
    return df.select(*dimensions, "tokens", "weight", "each", p.alias("p"), F.greatest(F.lit(1.0), F.col("each") * F.col("scale")).alias("residual"))


def counted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), topic: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(id_column, *keep, "source", "lang", (topic_of(text) if topic is None else topic).alias("topic"), F.size(words_of(F.col(text_column))).cast("long").alias("n_tokens"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", targets: dict = TARGETS, budget: float = BUDGET, keep: tuple[str, ...] = (), topic: Column | None = None) -> DataFrame:
    """Every document (with the columns keep) with its cell, token weight, chance
    and draw. topic: an expression over docs, such as the column of a classifier;
    without one, topic_of."""
    with scratch() as made:
        rows = stage_table(counted(docs, id_column, text_column, keep, topic), "mix")
        cells = stage_table(rows.filter("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
        raked = stage_table(rake(cells, targets=targets, budget=budget), "raked")
        made.release(rows, raked)
    raked = small(raked).select(*[F.col(d).alias(f"{d}_of") for d in DIMENSIONS], "each", "p", "residual")
    out = rows.join(raked, [F.col(d).eqNullSafe(F.col(f"{d}_of")) for d in DIMENSIONS] + [F.col("n_tokens") > 0], "left")
    p = F.coalesce("p", F.lit(0.0))
    return out.select(
        id_column, *keep, *DIMENSIONS, "n_tokens",
        F.coalesce(F.col("each") * F.col("n_tokens"), F.lit(0.0)).alias("weight"), p.alias("p"), F.coalesce("residual", F.lit(1.0)).alias("residual"),
        (draw_of(id_column) < p).alias("sampled"),
    )


def oracle() -> str:
    """mix() in DuckDB."""
    goals = {}
    for d, goal in TARGETS.items():
        share = f"(sum(tokens) OVER (PARTITION BY {d}))::DOUBLE / sum(tokens) OVER ()"
        goals[d] = "CASE " + " ".join(f"WHEN {d} = '{k}' THEN {w!r}" for k, w in goal.items()) + f" ELSE {share} END" if isinstance(goal, dict) else f"pow({share}, {goal!r})"
    sql = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, lang, CASE WHEN lower(t) LIKE '%licens%' OR lower(t) LIKE '%copyright%' OR lower(t) LIKE '%rights reserved%' THEN 'legal'
  WHEN regexp_matches(t, '[0-9A-Za-z]@[0-9A-Za-z]|\\([0-9]{{3}}\\) [0-9]{{3}}') THEN 'contact'
  WHEN (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 50 > length(t) THEN 'markup' ELSE 'prose' END AS topic,
  len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r WHERE n_tokens > 0 GROUP BY ALL),
g AS (SELECT *, {", ".join(f"{e} AS {d}_g" for d, e in goals.items())} FROM c),
v AS (SELECT *, {", ".join(f"tokens / sum(tokens) OVER (PARTITION BY {d}) AS {d}_part" for d in DIMENSIONS)}, tokens / sum(tokens) OVER () AS weight FROM g),
w_0 AS (SELECT source, lang, topic, tokens, {", ".join(f"{d}_g / sum({d}_g * {d}_part) OVER () AS {d}_goal" for d in DIMENSIONS)}, weight FROM v)"""
    # the rounds go on as in rake(): one step for each round, a check after every fourth from ROUNDS on
    last = "rk"
    for d in DIMENSIONS:
        last = f"(SELECT * REPLACE (weight * {d}_goal / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})"
    off = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {d}) / {d}_goal - 1)" for d in DIMENSIONS)
    sql = sql.replace("\nWITH ", "\nWITH RECURSIVE ", 1) + f""",
rk AS (SELECT 0 AS step, 'Infinity'::DOUBLE AS before, false AS done, * FROM w_0
  UNION ALL SELECT step + 1, CASE WHEN checked THEN off ELSE before END, checked AND (off <= {TOLERANCE!r} OR off > 0.999 * before OR step + 1 >= {MOST_ROUNDS}), * EXCLUDE (step, before, done, checked, off, each_off)
  FROM (SELECT *, (step + 1) % 4 = 0 AND step + 1 >= {ROUNDS} AS checked, max(each_off) OVER () AS off FROM (SELECT *, greatest({off}) AS each_off FROM {last} AS a) AS b) AS c WHERE NOT done),
s_0 AS (SELECT source, lang, topic, tokens, weight, weight / tokens AS each, {BUDGET!r} * sum(tokens) OVER () AS wanted, {BUDGET!r} * sum(tokens) OVER () AS scale FROM rk WHERE step = (SELECT max(step) FROM rk)),
fl AS (SELECT 0 AS step, false AS done, * FROM s_0
  UNION ALL SELECT step + 1, scale = old, * EXCLUDE (step, done, old) FROM (SELECT * REPLACE (greatest(scale, coalesce((wanted - sum(CASE WHEN each * scale >= 1 THEN tokens ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN each * scale >= 1 THEN 0 ELSE weight END) OVER (), 0), scale)) AS scale), scale AS old FROM fl) AS a WHERE NOT done),
filled AS (SELECT * FROM fl WHERE step = (SELECT max(step) FROM fl))"""
    return sql + f"""
SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(1e6 * coalesce(each * n_tokens, 0), 6) AS weight_ppm, round(CASE WHEN each IS NULL THEN 0 ELSE least(1, each * scale) END, 6) AS p,
  round(coalesce(greatest(1, each * scale), 1), 6) AS residual,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / pow(2, 48) < CASE WHEN each IS NULL THEN 0 ELSE least(1, each * scale) END AS sampled
FROM r LEFT JOIN filled s ON r.source IS NOT DISTINCT FROM s.source AND r.lang IS NOT DISTINCT FROM s.lang AND r.topic = s.topic AND n_tokens > 0"""
