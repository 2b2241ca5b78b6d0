"""Connected components of very large link tables, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm.shared import stored

MAX_ROUNDS = 200


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and that one on none: then the edges are the answer."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).collect()[0]["open"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node reachable) of every node of ``links`` (columns ``u``, ``v``).

    Large-star and small-star steps by turns: each node's larger neighbours, then its smaller ones, are hung on the
    smallest node seen. The number of rounds grows with the logarithm of the longest path. Minima are combined before
    they are shuffled; joins on a hub's rows are plain joins, which adaptive execution splits.
    """
    edges = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        small = large.join(least, "u").select(ends).select("e.u", F.col("e.m").alias("v")).filter("u != v")
        edges = stored(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
