"""Graph analytics over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators.components import connected_components
from evigrid.plans.lineage import tasks, written


def evidence_graph(evidence: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(graph_id, node_id, kind)`` and edges ``(graph_id, source, target, label)``: target, its
    plugins, and what each plugin extracted. Repeated plugin rows repeat edges, not nodes."""
    node = lambda df, expr, kind: df.select("graph_id", F.expr(expr).alias("node_id"), F.lit(kind).alias("kind"))
    target, plugin, entity = "concat('target:', target)", "concat('plugin:', plugin)", "concat('entity:', type, ':', value)"
    found = entities.join(
        evidence.select("graph_id", F.col("plugin").alias("p")).distinct(),
        (F.col("p") == F.col("source_plugin")) & (entities.graph_id == evidence.graph_id), "left_semi",
    )
    nodes = node(evidence, target, "target").union(node(evidence, plugin, "plugin")).union(node(found, entity, "entity")).distinct()
    edge = lambda df, a, b, label: df.select("graph_id", F.expr(a).alias("source"), F.expr(b).alias("target"), F.lit(label).alias("label"))
    return nodes, edge(evidence, target, plugin, "collected_by").union(edge(found, "concat('plugin:', source_plugin)", entity, "extracted"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Degree over one less than the nodes; repeated edges count, nodes without edges are left out
    (but a graph of one node has centrality 0)."""
    n = nodes.groupBy(graph).agg(F.count("*").alias("n"))
    ends = edges.select(graph, F.explode(F.array("source", "target")).alias("node_id")).groupBy(graph, "node_id").agg(F.count("*").alias("degree"))
    many = ends.join(n.where("n > 1"), graph).select(graph, "node_id", (F.col("degree") / (F.col("n") - 1)).alias("centrality"))
    single = nodes.join(n.where("n = 1"), graph).select(graph, "node_id", F.lit(0.0).alias("centrality"))
    return many.unionByName(single)


def hubs(centrality: DataFrame, threshold: float = 0.3, most: int = 5, graph: str = "graph_id") -> DataFrame:
    w = Window.partitionBy(graph).orderBy(F.desc("centrality"), "node_id")
    return centrality.where(F.col("centrality") >= threshold).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def cluster_sizes(edges: DataFrame) -> DataFrame:
    """``(component, size)`` of an undirected graph."""
    return connected_components(edges, "source", "target").groupBy("component").agg(F.count("*").alias("size"))


def distances(edges: DataFrame, start: DataFrame, most: int = 20) -> DataFrame:
    """``(node, distance)`` from the start nodes by breadth-first frontiers; each round joins the
    frontier only and drops what was reached before. Tasks follow the number of edges, so that one holds
    no more of a larger graph."""
    one = written(edges.select("source", "target"), "edges")
    both = one.union(one.select("target", "source"))
    both = written(both.repartition(tasks(both), "source", "target").distinct(), "both")
    reached = written(start.select(F.col("node"), F.lit(0).alias("distance")).distinct(), "reached")
    frontier = reached
    for d in range(1, most + 1):
        step = both.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = written(step.join(reached, "node", "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def redirect_chain(hops: DataFrame, most: int = 20) -> DataFrame:
    """``(start, n_hops, final, loop)`` of following ``(source, target)``; one target a source."""
    hop = written(hops.groupBy("source").agg(F.min("target").alias("next")), "hops")
    walk = hop.select(
        F.col("source").alias("start"), F.array("source").alias("path"), F.col("source").alias("at"),
        F.lit(False).alias("loop"), F.lit(False).alias("ended"),
    )
    for _ in range(most):
        step = walk.join(hop, walk.at == hop.source, "left")
        seen = F.array_contains("path", F.col("next"))
        go = ~F.col("ended") & F.col("next").isNotNull()
        walk = written(
            step.select(
                "start",
                F.when(go & ~seen, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
                F.when(go & ~seen, F.col("next")).otherwise(F.col("at")).alias("at"),
                (F.col("loop") | F.coalesce(go & seen, F.lit(False))).alias("loop"),
                (F.col("ended") | F.col("next").isNull() | F.coalesce(seen, F.lit(False))).alias("ended"),
            ),
            "walk",
        )
        if walk.where("NOT ended").isEmpty():
            break
    return walk.select("start", (F.size("path") - 1).alias("n_hops"), F.col("at").alias("final"), "loop")


def betweenness(edges: DataFrame, most_nodes: int = 100) -> DataFrame:
    """``(graph_id, node_id, betweenness)`` by one shortest path for each ordered pair, over
    graphs of at most ``most_nodes`` nodes (larger ones have none, as documented); paths prefer the
    lesser neighbour. Graphs are small by that bound, so each is one group."""
    import pandas as pd

    ends = edges.select(
        "graph_id", F.explode(F.array("source", "target")).alias("n"),
    ).groupBy("graph_id").agg(F.countDistinct("n").alias("size")).where(F.col("size") <= most_nodes)
    simple = edges.join(ends, "graph_id", "left_semi").select("graph_id", "source", "target").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(pdf["source"], pdf["target"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        through = dict.fromkeys(near, 0)
        for s in near:
            before, queue = {s: None}, [s]
            for x in queue:
                for y in sorted(near[x]):
                    if y not in before:
                        before[y] = x
                        queue.append(y)
            for t in queue[1:]:
                x = before[t]
                while x != s:
                    through[x] += 1
                    x = before[x]
        n = len(near)
        scale = (n - 1) * (n - 2) / 2
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "node_id": list(near), "betweenness": [through[x] / scale if scale > 0 else 0.0 for x in near]})

    kind = edges.schema["graph_id"].dataType.simpleString()
    return simple.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, node_id string, betweenness double")
