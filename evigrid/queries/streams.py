"""Streaming operators, run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence
from evigrid.streaming import monitors, stateful


@query("""WITH o AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT user_id AS monitor_id, event_id AS seq, old, event_type AS new, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change_count FROM o
  WHERE old IS NOT NULL AND old <> event_type""")
def stream_monitor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1-ST3: a user's event type as the fingerprint that is watched."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as the table may be one file
    seen = stream.select(
        F.col("user_id").alias("monitor_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("fingerprint"), F.lit(None).cast("string").alias("summary"),
    )
    return monitors.watched(seen).select("monitor_id", "seq", "old", "new", "change_count")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR"
    " WHEN c_custkey % 3 = 1 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY ELSE TIMESTAMP '2024-01-01' + INTERVAL 7 DAY END AS next_check FROM customer"
    " WHERE c_custkey % 3 < 2"
)
def due_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4, S3, M6: monitors that are due two days on."""
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    m = table(spark, sf_dir, "customer").select(
        "c_custkey",
        monitors.next_check(at, F.expr("element_at(array('hourly', 'daily', 'weekly'), CAST(1 + c_custkey % 3 AS INT))")).alias("next_check"),
        F.lit(True).alias("active"),
    )
    return monitors.due(m, F.lit("2024-01-03").cast("timestamp_ntz")).select("c_custkey", "next_check")


#: Days from which the second and the third micro-batch come.
DAYS = ("2024-01-11", "2024-01-21")


def _thirds(df: DataFrame, at: str) -> list[DataFrame]:
    a, b = (F.lit(d).cast("timestamp_ntz") for d in DAYS)
    t = F.col(at)
    return [df.where(t < a), df.where((t >= a) & (t < b)), df.where(t >= b)]


_RUNS = f"""WITH {EV}, runs AS (SELECT user_id AS m, date_trunc('day', ts) AS moment, min(event_id) AS seq, bool_or(event_type = 'purchase' AND k % 4 = 0) AS breach, bool_or(event_type = 'error' AND k % 5 = 0) AS cred,
  bool_or(event_type = 'error' AND k % 2 = 0) AS tor, CASE WHEN max(k) % 3 > 0 THEN '10.0.0.' || max(k) % 7 END AS ip, count(*) FILTER (event_type = 'view') * 4 AS certs,
  coalesce(list(DISTINCT 's' || k % 20) FILTER (event_type = 'click'), []) AS subdomains, coalesce(list(DISTINCT (k % 12)::VARCHAR) FILTER (event_type = 'signup'), []) AS ports,
  coalesce(list(DISTINCT 't' || k % 9) FILTER (event_type = 'error'), []) AS threats, coalesce(list(DISTINCT 'a' || k % 6) FILTER (event_type = 'view'), []) AS addresses
  FROM ev GROUP BY user_id, date_trunc('day', ts))"""
_SETS = {"subdomains": True, "ports": True, "threats": False, "addresses": True}
_LAGGED = ", ".join(f"lag({c}) OVER w AS o_{c}" for c in ("breach", "cred", "tor", "ip", "certs", *_SETS))


def _set_sql(c: str, word: str, new: str, old: str) -> str:
    both = f" AND len({c}) > 0 AND len(o_{c}) > 0" if c == "addresses" else ""
    diff = f"list_filter({new}, lambda x: NOT list_contains({old}, x))"
    return f"SELECT m, moment, seq, '{c} {word}' AS change, array_to_string(list_sort({diff}), ',') AS items, len({diff})::BIGINT AS n FROM o WHERE len({diff}) > 0{both}"


_CHANGES = " UNION ALL ".join(
    [_set_sql(c, "added", c, f"o_{c}") for c in _SETS]
    + [_set_sql(c, "removed", f"o_{c}", c) for c, gone in _SETS.items() if gone]
    + [f"SELECT m, moment, seq, '{word}', NULL, 1 FROM o WHERE {c}" for word, c in (("breach", "breach AND NOT o_breach"), ("credentials leaked", "cred AND NOT o_cred"), ("tor exit node", "tor AND NOT o_tor"), ("no tor exit node", "o_tor AND NOT tor"))]
    + ["SELECT m, moment, seq, 'ip', o_ip || ',' || ip, 1 FROM o WHERE ip <> o_ip", "SELECT m, moment, seq, 'certificates', NULL, certs - o_certs FROM o WHERE certs > o_certs + 5"]
)


@query(f"{_RUNS}, o AS (SELECT * FROM (SELECT *, row_number() OVER w AS nth, {_LAGGED} FROM runs WINDOW w AS (PARTITION BY m ORDER BY moment, seq)) WHERE nth > 1), c AS ({_CHANGES}) SELECT m AS monitor_id, moment::TIMESTAMP AS moment, seq, change, items, n FROM c")
def stream_typed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2, E14: changes by kind between the runs of monitors (a user's day), in three micro-batches."""
    k, kind = F.col("k"), F.col("event_type")
    some = lambda t, n: F.max((kind == t) & (k % n == 0))
    items = lambda t, c: F.collect_set(F.when(kind == t, c))
    runs = evidence(spark, sf_dir).groupBy(F.col("user_id").alias("monitor_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(
        F.min("event_id").alias("seq"), some("purchase", 4).alias("breach"), some("error", 5).alias("credentials"), some("error", 2).alias("tor"),
        F.when(F.max(k) % 3 > 0, F.concat(F.lit("10.0.0."), F.max(k) % 7)).alias("ip"), (F.count_if(kind == "view") * 4).alias("certificates"),
        F.create_map(
            F.lit("subdomains"), items("click", F.concat(F.lit("s"), k % 20)), F.lit("ports"), items("signup", (k % 12).cast("string")),
            F.lit("threats"), items("error", F.concat(F.lit("t"), k % 9)), F.lit("addresses"), items("view", F.concat(F.lit("a"), k % 6)),
        ).alias("sets"),
    )
    found = stateful.over_batches(_thirds(runs, "at"), stateful.monitor_changes, "typed")
    return found.withColumnRenamed("at", "moment")


@query(
    f"WITH {EV}, f AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING"
    f" AND CURRENT ROW) AS n FROM ev WHERE event_type = 'error') SELECT user_id AS plugin_id, min(ts) FILTER (n >= 3) AS quarantined_at, max(n) AS n_failures FROM f"
    f" GROUP BY user_id HAVING max(n) >= 3"
)
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: quarantines from failures that come in three micro-batches; the same rows as ``quarantine_24h``."""
    failed = evidence(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("plugin_id"), F.col("ts").alias("failed_at"))
    found = stateful.over_batches(_thirds(failed, "failed_at"), stateful.quarantines(), "quarantine")
    return found.groupBy("plugin_id").agg(F.min("quarantined_at").alias("quarantined_at"), F.max("n_failures").alias("n_failures"))


@query(f"""WITH RECURSIVE {EV}, q AS (SELECT user_id AS client, event_id AS request_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id
  ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM ev),
w AS (SELECT client, n, request_id, true AS ok, t AS a, NULL::BIGINT AS b FROM q WHERE n = 1
UNION ALL SELECT q.client, q.n, q.request_id, w.b IS NULL OR w.b <= q.t - 3600, CASE WHEN w.b IS NULL OR w.b <= q.t - 3600 THEN q.t ELSE w.a END, CASE WHEN w.b IS NULL
  OR w.b <= q.t - 3600 THEN w.a ELSE w.b END FROM w JOIN q ON q.client = w.client AND q.n = w.n + 1)
SELECT client, request_id FROM w WHERE ok""")
def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6: a limiter over requests that come in three micro-batches; the same rows as ``allowed_requests``."""
    asked = evidence(spark, sf_dir).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    return stateful.over_batches(_thirds(asked, "at"), stateful.limited(2, 3600), "limiter")
