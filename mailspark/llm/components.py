"""Connected components with joins: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.llm.storage import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's larger (or smaller) neighbours are linked with its smallest neighbour.

    The smallest neighbour is a partial sum: a node with very many links costs one row a task.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that the join with it is of plain shuffles, which Spark splits where a node has very many links.
    least = stash(near.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), both of one type that orders -> (node, component), component the smallest node reachable.

    Nodes without edges have no row.
    """
    now = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).collect()[0]
        if (count, total) == before or not count:
            break
        before = (count, total)
        now = stash(_star(_star(now, large=True), large=False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
