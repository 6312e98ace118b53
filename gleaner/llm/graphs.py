"""Connected components of an edge table, by alternating stars.

Each round replaces every node's edges by edges to its smallest neighbour, once
for its larger and once for its smaller neighbours, until each component is one
star around its smallest node. Smallest neighbours are found by partial
aggregation; where edges are joined to them, those of a hot centre are dealt
over several tasks (common.meet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, meet, stage_table


def _stars(edges: DataFrame, larger: bool, count: int) -> DataFrame:
    """edges (u, v), u > v, not above count. Larger: each node links its larger
    neighbours to its smallest one; else each node links itself and its smaller
    neighbours."""
    sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
    if larger:
        least = least.withColumn("m", F.least("m", "u"))
    joined = meet(sides, least, "u", F.xxhash64("v"), 2 * count)
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) that isn't its component's
    smallest node, root being that smallest node."""
    now = stage_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        last, now = now, stage_table(_stars(_stars(now, True, mark[0]), False, mark[0]), "stars")
        discard(last)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
