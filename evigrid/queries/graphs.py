"""Graph analytics over events, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import graph
from evigrid.plans.lineage import tasks
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence

_GRAPH = f"""WITH {EV}, s AS (SELECT DISTINCT user_id AS g, event_type AS p, k % 20 AS v FROM ev), e AS (SELECT g, 'target:u' || g AS a, 'plugin:' || p AS b
  FROM (SELECT DISTINCT g, p FROM s) UNION ALL SELECT g, 'plugin:' || p, 'entity:k:' || v FROM s),
n AS (SELECT g, count(*) AS n FROM (SELECT g, a AS x FROM e UNION SELECT g, b FROM e) GROUP BY g), c AS (SELECT g, x, count(*) / (n - 1) AS c FROM (SELECT g, a AS x
  FROM e UNION ALL SELECT g, b FROM e) JOIN n USING (g) GROUP BY g, x, n)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = evidence(spark, sf_dir).selectExpr("user_id AS graph_id", "event_type AS plugin", "CAST(k % 20 AS STRING) AS value").distinct()
    ev = s.select("graph_id", "plugin").distinct().withColumn("target", F.concat(F.lit("u"), "graph_id"))
    return graph.evidence_graph(ev, s.select("graph_id", F.col("plugin").alias("source_plugin"), F.lit("k").alias("type"), "value"))


@query(_GRAPH + " SELECT g AS graph_id, x AS node_id, round(c, 9) AS centrality FROM c")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1, GR2, J18: target, plugin and entity nodes of each investigation."""
    found = graph.degree_centrality(*_graph(spark, sf_dir))
    return found.withColumn("centrality", F.round("centrality", 9))


@query(
    _GRAPH + " SELECT graph_id, node_id, place, round(c, 9) AS centrality FROM (SELECT g AS graph_id, x AS node_id, c, row_number() OVER (PARTITION BY g ORDER BY c DESC, x) AS place FROM c WHERE c >= 0.3) WHERE place <= 5"
)
def hubs_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4, GR7, O8."""
    found = graph.hubs(graph.degree_centrality(*_graph(spark, sf_dir)))
    return found.select("graph_id", "node_id", "place", F.round("centrality", 9).alias("centrality"))


_EDGES = "e AS (SELECT DISTINCT o_custkey AS a, 1000000 + l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated edges stay: to tell them apart is a shuffle more, and no reader here needs it."""
    li = table(spark, sf_dir, "lineitem")
    n = tasks(li)
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), li.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target"))


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: customers and parts linked by line items (recursive SQL is too slow on whole tables; tested
    against a union-find)."""
    return graph.cluster_sizes(_edges(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_EDGES}, s AS (SELECT min(a) AS m FROM e), r AS (SELECT m AS node, 0 AS distance FROM s UNION SELECT both_.b, r.distance + 1 FROM r"
    f" JOIN both_ ON r.node = both_.a WHERE r.distance < 20) SELECT node, min(distance) AS distance FROM r GROUP BY node"
)
def bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5: distances up to twenty from the least customer."""
    edges = _edges(spark, sf_dir)
    return graph.distances(edges, edges.agg(F.min("source").alias("node")), 20)


@query("""WITH RECURSIVE h AS (SELECT p_partkey AS a, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_partkey * 7 + p_size) % 150 END AS b FROM part), w AS (SELECT a AS start,
  [a] AS path, a AS pos, false AS loop FROM h WHERE b IS NOT NULL
UNION ALL SELECT start, CASE WHEN list_contains(path, b) THEN path ELSE list_append(path, b) END, CASE WHEN list_contains(path, b) THEN pos ELSE b END,
  list_contains(path, b) FROM w JOIN h ON w.pos = h.a WHERE b IS NOT NULL AND NOT loop AND len(path) < 20 + 1)
SELECT start, max(len(path) - 1) AS n_hops, arg_max(pos, len(path)) AS final, bool_or(loop) AS loop FROM w GROUP BY start""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR9, P52: chains of at most 20 hops, with loops noticed."""
    hops = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS source", "IF(p_size % 4 = 0, NULL, (p_partkey * 7 + p_size) % 150) AS target",
    ).where("target IS NOT NULL")
    return graph.redirect_chain(hops, 20).selectExpr("start", "CAST(n_hops AS BIGINT) AS n_hops", "final", "loop")


@query()
def betweenness_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR6 (paths of equal length are chosen by least neighbour; tested against a brute-force count)."""
    return graph.betweenness(_graph(spark, sf_dir)[1])
