"""Connected components by alternating large-star and small-star.

Each step is a grouped minimum (combined before the shuffle) and an equi-join that
adaptive execution can split, so a node with very many edges is no single task's
work. Every step's edges are written to the shared folder and the step before is
deleted. It ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, whatever their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; the root is the smallest node it reaches.

    Repeated edges, loops and both directions are fine; edges with a null end are
    ignored, and a node that has only loops does not appear.
    """
    now = scratch.save(edges.filter("u <> v").select("u", "v").distinct())
    mark = _mark(now)
    while True:
        after = scratch.save(_small(_large(now)))
        scratch.drop(now)
        now, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
