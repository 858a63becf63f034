"""Source kernels over the input tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import plugins
from evigrid.operators import levels
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence


@query(
    "SELECT user_id, min(strftime(ts, '%Y%m%d%H%M%S')) AS first, max(strftime(ts, '%Y%m%d%H%M%S')) AS last, count(DISTINCT strftime(ts, '%Y%m')) AS n_months FROM events GROUP BY user_id"
)
def wayback_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P72."""
    return plugins.snapshots_by_month(evidence(spark, sf_dir).select("user_id", F.date_format("ts", "yyyyMMddHHmmss").alias("s")), "user_id", "s")


@query(f"WITH {EV} SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS date, arg_min(event_type, (strftime(ts, '%Y-%m-%d'), event_id)) AS source FROM ev GROUP BY user_id")
def earliest_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, A17."""
    rows = evidence(spark, sf_dir).select("user_id", F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("pos"))
    return plugins.earliest_signal(rows, "user_id")


@query(f"""WITH {EV} SELECT user_id, list_sort(list(CASE WHEN k % 9 = 0 THEN '0000-00-00' ELSE strftime(ts, '%Y-%m-%d') END)) AS dates, CASE
  WHEN bool_or(k = 7) THEN 'critical' WHEN bool_or(k % 2 = 0) THEN 'high' ELSE 'medium' END AS worst, list_sort(list(DISTINCT 'kind' || (k % 5))) AS kinds FROM ev
  WHERE event_type = 'error' GROUP BY user_id""")
def breach_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    rows = evidence(spark, sf_dir).where("event_type = 'error'").select(
        "user_id", F.when(F.col("k") % 9 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.expr("CASE WHEN k = 7 THEN 'critical' WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END").alias("severity"),
        F.array(F.concat(F.lit("kind"), F.col("k") % 5)).alias("kinds"),
    )
    return plugins.breach_timeline(rows, "user_id")


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS n FROM pages), r AS (SELECT n, regexp_extract(n, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS root FROM h)
SELECT root, list_sort(list(n)) AS subdomains, count(*) AS total FROM r WHERE suffix(n, '.' || root) AND root <> '' GROUP BY root""")
def subdomain_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages under their domain, from two spellings of each."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    h = table(spark, sf_dir, "pages").select(host.alias("n"))
    both = h.union(h.select(F.upper(F.concat(F.lit("*."), "n"))))
    rows = both.select("n", F.regexp_extract(F.lower("n"), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("root")).where("root <> ''")
    return plugins.subdomains(rows, "root", "n")


@query(
    f"WITH {EV}, p AS (SELECT user_id, list_sort(list(DISTINCT k)) AS ports FROM ev GROUP BY user_id) SELECT user_id, ports, list_filter(ports, lambda x: x IN (21,"
    f" 22, 23, 25)) AS risky FROM p"
)
def port_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P50, P57."""
    return plugins.ports(evidence(spark, sf_dir).select("user_id", F.col("k").cast("int").alias("k")), "user_id", "k")


@query("SELECT event_id, 'field:k' AS observation_type, json_extract_string(props, '$.k') AS value FROM events")
def adapter_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar fields of raw payloads."""
    return plugins.adapter_observations(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"""WITH {EV}, r AS (SELECT user_id, type, k, event_id, row_number() OVER (PARTITION BY user_id, type ORDER BY event_id) AS p FROM ev)
SELECT user_id, type, k::VARCHAR AS value, 70 AS confidence FROM r WHERE p <= CASE type WHEN 'domain' THEN 5 WHEN 'email' THEN 3 ELSE 1000000 END GROUP BY user_id, type, k""")
def followup_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, E4."""
    rows = evidence(spark, sf_dir).select("user_id", "type", F.col("k").cast("string").alias("value"), F.col("event_id").alias("pos"))
    return plugins.followups(rows, "user_id", {"domain": 5, "email": 3})


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 4 AS needs FROM part WHERE p_partkey >= 4 UNION SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey >= 7
  UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 0 UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 0),
a AS (SELECT node FROM e UNION SELECT needs FROM e UNION SELECT p_partkey FROM part),
r AS (SELECT node, 0 AS level FROM a WHERE node NOT IN (SELECT node FROM e) UNION SELECT e.node, r.level + 1 FROM r JOIN e ON e.needs = r.node WHERE r.level < 60)
SELECT node, CASE WHEN max(level) < 40 THEN max(level) END AS level FROM r GROUP BY node""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: levels of parts that need two others each, with pairs that need each other."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    pair = part.where("node % 97 = 0 AND node > 0")
    edges = [part.where("node >= 4").selectExpr("node", "node div 4 AS needs"), part.where("node >= 7").selectExpr("node", "node div 7 AS needs"), pair.selectExpr("node", "node + 1 AS needs"), pair.selectExpr("node + 1 AS node", "node AS needs")]
    return levels.levels(reduce(DataFrame.unionByName, edges), part)
