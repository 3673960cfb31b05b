"""Connected components of a table of edges, by alternating large and small stars.

Each round is two aggregations and two joins on node ids, of which a hub's rows
are split by adaptive execution (the other side has one row a node); nothing of the graph
reaches the driver but a count and a checksum.  Rounds are written to the
shared folder, so the plan stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; edges go from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(u, v)``; the root is the component's smallest node.

    Loops and repeated edges change nothing; no edges give an empty table.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, before = mark, now
        now = materialize(_small(_large(now)), 2 * mark[0])
        discard(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.distinct())
