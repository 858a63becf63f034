"""Risk scoring and change monitoring over events as payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import scoring
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence

#: What a user's events say, as payload fields: distinct values of two types and counts of others.
_P = f"""WITH {EV}, p AS (SELECT user_id, list_sort(list(DISTINCT k) FILTER (event_type = 'error' AND k < 8)) AS threats,
  list_sort(list(DISTINCT k) FILTER (event_type = 'purchase' AND k < 6)) AS vulns,
 list_sort(list(DISTINCT k) FILTER (event_type = 'click' AND k < 90)) AS ports, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'signup')
  AS signups FROM ev GROUP BY user_id),
q AS (SELECT user_id, coalesce(len(threats), 0) AS n_t, coalesce(len(vulns), 0) AS n_v, coalesce(ports, []) AS ports, len(list_filter(coalesce(ports, []),
  lambda x: x IN (22, 23))) AS risky, views % 3 = 0 AS tor, views % 4 = 0 AS leaked, signups % 2 = 0 AS disposable, views % 2 = 0 AS proxy, views * 4 AS subs FROM p)"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = lambda t, most: F.array_sort(F.collect_set(F.when((F.col("event_type") == t) & (F.col("k") < most), F.col("k").cast("int"))))
    n = lambda t: F.count_if(F.col("event_type") == t)
    p = evidence(spark, sf_dir).groupBy(F.col("user_id").alias("investigation_id")).agg(
        kinds("error", 8).alias("threats"), kinds("purchase", 6).alias("vulns"),
        kinds("click", 90).alias("ports"), n("view").alias("views"), n("signup").alias("signups"),
    )
    text = F.to_json(
        F.struct(
            F.struct(
                F.transform("threats", lambda t: F.concat(F.lit("threat-"), t)).alias("threats"),
                (F.col("views") % 3 == 0).alias("is_tor_exit"),
            ).alias("reputation"),
            F.struct(F.transform("vulns", lambda t: F.concat(F.lit("CVE-2024-"), t)).alias("all_vulns"), F.col("ports").alias("all_open_ports")).alias("shodan"),
            F.struct((F.col("views") % 4 == 0).alias("credentials_leaked"), F.lit(False).alias("breach_found")).alias("breach"),
            F.struct((F.col("signups") % 2 == 0).alias("disposable")).alias("email"),
            F.struct((F.col("views") % 2 == 0).alias("is_proxy")).alias("ip_geo"),
            F.struct((F.col("views") * 4).cast("int").alias("total_found")).alias("subdomains"),
        )
    )
    return p.select("investigation_id", F.parse_json(text).alias("data"))


@query(_P + """, s AS (SELECT user_id, n_t, risky, leaked, tor, proxy, subs, n_v, least(100, least(n_t, 3) * 8 + CASE WHEN tor THEN 15 ELSE 0 END + least(n_v,
  3) * 10 + risky * 5 + CASE WHEN leaked THEN 20 ELSE 0 END + CASE WHEN disposable THEN 6 ELSE 0 END + CASE WHEN proxy THEN 10 ELSE 0 END + CASE WHEN subs > 50 THEN 8
  ELSE 0 END)::INT AS score FROM q),
g AS (SELECT *, list_filter([CASE WHEN subs > 0 THEN 'Reconnaissance' END, CASE WHEN n_v > 0 OR risky > 0 THEN 'Weaponization' END, CASE WHEN n_t > 0 THEN 'Delivery' END,
  CASE WHEN leaked THEN 'Exploitation' END, CASE WHEN tor OR proxy THEN 'Command and Control' END], lambda x: x IS NOT NULL) AS st FROM s)
SELECT user_id AS investigation_id, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE
  WHEN score >= 75 THEN 'RED' WHEN score >= 25 THEN 'AMBER' ELSE 'GREEN' END AS tlp, CASE WHEN len(st) = 0 THEN ['Reconnaissance'] ELSE st END AS stages FROM g""")
def threat_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6."""
    return scoring.threat_scores(_payloads(spark, sf_dir)).drop("categories")


@query(_P + """, v AS (SELECT user_id, coalesce(vulns, []) AS vulns FROM p), s AS (SELECT q.*, vulns, least(100, least(n_t, 3) * 8 + CASE WHEN tor THEN 15 ELSE 0 END + least(n_v, 3) * 10 + risky * 5 + CASE WHEN leaked THEN 20 ELSE 0 END
  + CASE WHEN disposable THEN 6 ELSE 0 END + CASE WHEN proxy THEN 10 ELSE 0 END + CASE WHEN subs > 50 THEN 8 ELSE 0 END) AS score FROM q JOIN v USING (user_id)),
r AS (SELECT user_id, list_filter([CASE WHEN score >= 75 THEN ('isolate', '') END, CASE WHEN n_v > 0 THEN ('patch', array_to_string(list_transform(vulns[1:5], lambda x: 'CVE-2024-' || x), ', ')) END,
  CASE WHEN risky > 0 THEN ('close_ports', array_to_string(list_filter(ports, lambda x: x IN (22, 23)), ', ')) END, CASE WHEN leaked THEN ('reset_passwords', '') END, CASE WHEN disposable THEN ('block_disposable', '') END,
  CASE WHEN subs > 50 THEN ('audit_subdomains', '') END, CASE WHEN tor OR proxy THEN ('watch_traffic', '') END], lambda x: x IS NOT NULL) AS l FROM s),
e AS (SELECT user_id, CASE WHEN len(l) = 0 THEN [('none', '')] ELSE l END AS l FROM r)
SELECT user_id AS investigation_id, (i - 1)::INT AS place, l[i][1] AS advice, l[i][2] AS about FROM (SELECT user_id, l, unnest(range(1, len(l) + 1)) AS i FROM e)""")
def threat_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each score."""
    found = scoring.recommendations(_payloads(spark, sf_dir))
    return found.select("investigation_id", "place", "advice", F.coalesce("about", F.lit("")).alias("about"))


@query(_P + """, s AS (SELECT user_id, (least(n_t, 3) + CASE WHEN tor THEN 2 ELSE 0 END + least(n_v, 3) + CASE WHEN leaked THEN 2 ELSE 0 END + CASE WHEN proxy THEN 2
  ELSE 0 END + CASE WHEN disposable THEN 1 ELSE 0 END)::BIGINT AS points FROM q)
SELECT user_id AS investigation_id, points, CASE WHEN points >= 5 THEN 'CRITICAL' WHEN points >= 3 THEN 'HIGH' WHEN points >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def threat_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other scale, from one row a plugin."""
    p = _payloads(spark, sf_dir)
    names = ("reputation", "shodan", "breach", "ip_geo", "email")
    rows = p.select(
        "investigation_id",
        F.inline(
            F.array(*(F.struct(F.lit(n).alias("plugin_name"), F.try_variant_get("data", f"$.{n}", "variant").alias("data"), F.lit(True).alias("success")) for n in names))
        ),
    )
    return scoring.threat_levels(rows)


_T = ", t AS (SELECT user_id, unnest(list_filter([CASE WHEN tor THEN 'T1090.003' END, CASE WHEN len(ports) > 0 THEN 'T1046' END, CASE WHEN list_contains(ports, 80) THEN 'T1071.001' END, CASE WHEN list_contains(ports, 53) THEN 'T1071.004' END, CASE WHEN list_contains(ports, 22) THEN 'T1133' END, CASE WHEN n_v > 0 THEN 'T1190' END, CASE WHEN leaked THEN 'T1078' END], lambda x: x IS NOT NULL)) AS technique_id FROM q)"


@query(_P + _T + " SELECT user_id AS investigation_id, technique_id FROM t")
def attack_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    return scoring.techniques(_payloads(spark, sf_dir)).select("investigation_id", "technique_id")


@query(_P + _T + " SELECT technique_id, count(DISTINCT user_id) AS n_investigations, 'medium' AS severity FROM t GROUP BY technique_id")
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, E10, O6."""
    return scoring.risk_matrix(scoring.techniques(_payloads(spark, sf_dir))).select("technique_id", "n_investigations", "severity")


@query(
    _P + " SELECT user_id AS investigation_id, unnest(list_filter([CASE WHEN tor THEN 'tor' END, CASE WHEN proxy THEN 'proxy' END, CASE WHEN leaked THEN 'credentials-leaked' END, CASE WHEN disposable THEN 'disposable-email' END, CASE WHEN n_v > 0 THEN 'vulnerable' END, CASE WHEN len(ports) > 0 THEN 'exposed-ports' END, CASE WHEN n_v > 0 THEN 'has-cve' END], lambda x: x IS NOT NULL)) AS tag FROM q"
)
def suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    return scoring.tags(_payloads(spark, sf_dir))


_METRICS = f"WITH {EV}, m AS (SELECT DISTINCT user_id, event_type AS metric, lpad(k::VARCHAR, 4, '0') AS value, ts < TIMESTAMP '2024-01-16' AS old FROM ev)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select(
        "user_id", F.col("event_type").alias("metric"),
        F.lpad(F.col("k").cast("string"), 4, "0").alias("value"),
        (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"),
    )


@query(
    _METRICS + ", b AS (SELECT user_id, metric, value, bool_or(old) AS o, bool_or(NOT old) AS n FROM m GROUP BY ALL) SELECT user_id, metric, coalesce(list_sort(list(value) FILTER (NOT o)), []) AS added, coalesce(list_sort(list(value) FILTER (NOT n)), []) AS removed FROM b GROUP BY user_id, metric HAVING bool_or(NOT o OR NOT n)"
)
def monitor_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of the month has that the first had not, and the reverse."""
    m = _metrics(spark, sf_dir)
    return scoring.snapshot_diff(m.where("old"), m.where("NOT old"), ["user_id"])


@query(
    _METRICS + " SELECT user_id, old, sha256(string_agg(DISTINCT metric || '=' || value, ';' ORDER BY metric || '=' || value)) AS fingerprint FROM m GROUP BY user_id, old"
)
def monitor_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13."""
    return scoring.fingerprint(_metrics(spark, sf_dir), ["user_id", "old"])


@query("SELECT doc_id AS evidence_id, doc_id % 4 > 0 AS intact FROM documents")
def integrity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document was changed after its last custody record."""
    d = table(spark, sf_dir, "documents")
    ev = d.select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("payload"))
    old = d.select(F.col("doc_id").alias("evidence_id"), F.sha2(F.concat("text", F.lit("?")), 256).alias("sha256"), F.lit(1).alias("recorded_at"))
    new = d.select(
        F.col("doc_id").alias("evidence_id"),
        F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
        F.lit(2).alias("recorded_at"),
    )
    return scoring.integrity_drift(ev, old.union(new)).select("evidence_id", "intact")
