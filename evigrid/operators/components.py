"""Connected components by alternating stars.

Each round connects every node to the least node it knows (large star: among
larger neighbours; small star: among smaller ones). Both halves are a grouped
minimum and a join, so a node with many neighbours is pre-aggregated before its
shuffle and its join side can be split by adaptive execution.

Rounds over many edges are spared: two edges of each node, its least and its greatest,
give components of their own, all edges are named by these once, and only those
between two of them are left for the next pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.plans.lineage import ROWS, written


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(now: DataFrame, max_rounds: int) -> DataFrame:
    """``(node, component)`` by rounds of stars over edges ``(a, b)`` with a > b."""
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = written(_round(now), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct())


def _contracted(edges: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` of the graph of each node's least and greatest neighbour, and the edges
    between two of these components. At least every second node stops being one of its own."""
    both = edges.union(edges.select("b", "a"))
    picked = both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).select("a", F.explode(F.array("least", "most")).alias("b"))
    picked = written(_descending(picked).distinct(), "picked")
    named = written(_stars(picked, max_rounds), "named")
    # Names are hashed, edges stream past them; adaptive execution splits the edges of a hub.
    of = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")).hint("shuffle_hash")
    rest = edges.join(of("a"), "a").select("_a", "b").join(of("b"), "b").where("_a <> _b")
    return named, written(_descending(rest.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).distinct(), "rest")


def _descending(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, many: int = ROWS) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    The component is its least node. Null ends and self-loops are ignored, so a
    node met only in those does not appear; repeated edges change nothing; an
    empty edge list gives an empty result. More than ``many`` edges are contracted before stars
    go over them.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = written(_descending(now.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")), "edges")
    found = None
    while now.count() > many:
        named, now = _contracted(now, max_rounds)
        found = named if found is None else written(_renamed(found, named), "found")
    rest = _stars(now, max_rounds)
    return rest if found is None else _renamed(found, written(rest, "last"))


def _renamed(found: DataFrame, named: DataFrame) -> DataFrame:
    """Components by the components that they were joined to."""
    to = named.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return found.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
