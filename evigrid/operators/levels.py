"""Levels of dependencies, by rounds over their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.plans.lineage import written


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, level)``: 0 for what needs nothing, else one more than the highest of what it needs; null for
    what needs, however indirectly, itself.

    ``edges`` has ``node, needs``; ``nodes`` (``node``) names those without edges. Each round takes away
    the edges onto what is settled and settles the nodes that have none left: as many rounds as
    the longest chain, each a pair of joins. These are sort-merge joins, as broadcasts of every round
    would add up in the driver. What is left when a round settles nothing is in a circle
    or hangs on one. Nulls are left out, repeated edges count once.
    """
    edges = written(edges.where("node IS NOT NULL AND needs IS NOT NULL").select("node", "needs").distinct(), "edges")
    every = edges.select("node").union(edges.select("needs"))
    if nodes is not None:
        every = every.union(nodes.where("node IS NOT NULL").select("node"))
    left = edges
    ready = every.distinct().join(edges.select("node").hint("merge"), "node", "left_anti")
    done, level = [], 0
    while True:
        ready = written(ready.select("node", F.lit(level).alias("level")), "level")
        if ready.isEmpty():
            break
        done.append(ready)
        rest = written(left.join(ready.select(F.col("node").alias("needs")).hint("merge"), "needs", "left_anti"), "edges")
        ready, left, level = left.select("node").distinct().join(rest.select("node").hint("merge"), "node", "left_anti"), rest, level + 1
    stuck = left.select("node").distinct().select("node", F.lit(None).cast("int").alias("level"))
    for d in done:
        stuck = stuck.unionByName(d)
    return stuck
