"""Correlation, rules and event logs over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import correlate, events, rules
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, SPLIT, evidence, halves

_W = "w(type, tier, wt) AS (VALUES ('email', 1, 0.90::DOUBLE), ('username', 2, 0.55), ('domain', 2, 0.45), ('display_name', 3, 0.20), ('language', 3, 0.10))"
_SCORE = f"""WITH {EV}, {_W}, d AS (SELECT user_id AS draft, type, k, event_id % 7 AS evid FROM ev WHERE ts < TIMESTAMP '2024-01-16'), g AS (SELECT DISTINCT user_id
  AS known, type, k FROM ev WHERE ts >= TIMESTAMP '2024-01-16'),
m AS (SELECT draft, known, tier, evid, max(wt) AS wt, count(*) AS n FROM d JOIN g USING (type, k) JOIN w USING (type) WHERE draft <> known GROUP BY ALL),
r AS (SELECT draft, known, coalesce(1 - product(1 - wt) FILTER (tier = 1), 0) AS r1, coalesce(1 - product(1 - wt) FILTER (tier = 2), 0) AS r2,
  coalesce(1 - product(1 - wt) FILTER (tier = 3), 0) AS r3, min(tier) AS decisive_tier, sum(n)::BIGINT AS n_matches FROM m GROUP BY ALL),
s AS (SELECT draft, known, decisive_tier, n_matches, r2 > 0.75 OR r3 > 0.45 AS capped, round(greatest(0, least(1, CASE decisive_tier WHEN 1 THEN r1 + 0.1 * least(r2,
  0.75) + 0.1 * least(r3, 0.45) WHEN 2 THEN least(r2, 0.75) + 0.1 * least(r3, 0.45) ELSE least(r3, 0.45) END)), 6) AS score FROM r)"""


@query(_SCORE + " SELECT * FROM s")
def correlate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft against every known identity that shares a value."""
    draft, known = halves(spark, sf_dir)
    return correlate.pair_scores(draft, known, correlate.signals(spark), only=("decisive_tier", "n_matches", "capped", "score"))


_FIRED = """, p AS (SELECT *, 'high_confidence_auto_merge' AS rule_id, 'auto_merge' AS kind, 3 AS priority FROM s WHERE score >= 0.9 AND decisive_tier = 1 UNION ALL
  SELECT *, 'review_band', 'queue_review', 1 FROM s WHERE score >= 0.5 AND score < 0.9
 UNION ALL SELECT *, 'watchlist_hit', 'queue_review', 1 FROM s WHERE (draft, known) IN (SELECT draft, known FROM d JOIN g USING (type, k) WHERE k % 97 = 5))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft, known = halves(spark, sf_dir)
    watchlist = known.select("value").where("CAST(value AS INT) % 97 = 5").distinct()
    found = correlate.pair_scores(rules.marked(draft, watchlist), known, correlate.signals(spark), only=("decisive_tier", "n_matches", "on_watchlist", "score"))
    return found.withColumns({"n_entities": F.col("n_matches"), "n_evidence": F.col("n_matches")})


@query(_SCORE + _FIRED + " SELECT draft, known, rule_id, kind, priority, score FROM p")
def rule_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that fires for a pair."""
    return rules.proposals(_pairs(spark, sf_dir)).select("draft", "known", "rule_id", "kind", "priority", "score")


@query(
    _SCORE + _FIRED + " SELECT draft, known, rule_id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY draft, known ORDER BY priority, score DESC, rule_id) AS n FROM p) WHERE n = 1"
)
def correlate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proposal that wins."""
    return rules.decided(_pairs(spark, sf_dir)).select("draft", "known", "rule_id", "kind", "score")


_RARE = "k * 1000 + user_id % 50 * 10 + event_id % 3"


@query(f"""WITH {EV}, {_W}, d AS (SELECT user_id AS draft, type, {_RARE} AS v, event_id % 7 AS evid FROM ev WHERE ts < TIMESTAMP '2024-01-16' AND type = 'email'),
g AS (SELECT DISTINCT user_id AS known, type, {_RARE} AS v FROM ev WHERE ts >= TIMESTAMP '2024-01-16'), m AS (SELECT DISTINCT draft FROM d JOIN g USING (type, v) WHERE draft <> known)
SELECT draft, count(DISTINCT evid) AS n_evidence, 'no_overlap_promotion' AS rule_id, 'promote' AS kind FROM d WHERE draft NOT IN (SELECT draft FROM m) GROUP BY draft""")
def promotion_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities whose e-mail addresses (of many digits, so that few are shared) no known identity has."""
    value = F.expr(f"CAST({_RARE} AS STRING)")
    ev = evidence(spark, sf_dir).select(F.col("user_id").alias("identity"), "type", value.alias("value"), (F.col("event_id") % 7).alias("evidence_id"), "ts")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    draft, known = ev.where((F.col("ts") < cut) & (F.col("type") == "email")), ev.where(F.col("ts") >= cut)
    found = correlate.pair_scores(draft, known, correlate.signals(spark))
    pairs = found.withColumns({"n_entities": F.col("n_matches"), "n_evidence": F.col("n_matches"), "on_watchlist": F.lit(False)})
    fired = rules.proposals(rules.with_unmatched(pairs, draft), ("no_overlap_promotion",))
    return fired.select("draft", "n_evidence", "rule_id", "kind")


@query(_SCORE + " SELECT known, count(*) AS n_drafts, max(score) AS best, arg_max(draft, score * 1e9 - draft) AS best_draft FROM s GROUP BY known")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best draft of each known identity."""
    return correlate.best_drafts(*halves(spark, sf_dir), correlate.signals(spark))


_REL = "rel AS (SELECT o_custkey AS c, l_returnflag AS t, l_suppkey AS a, l_partkey AS b, l_orderkey % 3 AS e, o_orderdate < TIMESTAMP '1996-01-01' AS old FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""WITH {_REL}, m AS (SELECT x.c AS draft, y.c AS known, x.e, count(*) AS n FROM rel x JOIN (SELECT DISTINCT c, t, a, b FROM rel WHERE NOT old) y ON x.t = y.t
  AND x.a = y.a AND x.b = y.b WHERE x.old AND x.c <> y.c GROUP BY ALL)
SELECT draft, known, 3 AS decisive_tier, round(least(0.45, 1 - product(1 - 0.45)), 6) AS score, sum(n)::BIGINT AS n_matches FROM m GROUP BY draft, known""")
def relationship_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that share relationships only."""
    rel = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rel = rel.selectExpr(
        "o_custkey AS identity", "l_returnflag AS relationship_type", "'ip' AS source_type",
        "CAST(l_suppkey AS STRING) AS source_value", "'ip' AS target_type",
        "CAST(l_partkey AS STRING) AS target_value", "l_orderkey % 3 AS evidence_id",
        "o_orderdate < TIMESTAMP_NTZ '1996-01-01' AS old",
    )
    found = correlate.relationship_matches(rel.where("old"), rel.where("NOT old"))
    return correlate.scores(found).select("draft", "known", "decisive_tier", "score", "n_matches")


@query("""WITH d AS (SELECT o_orderkey AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'auto_merge' WHEN 'O' THEN 'queue_review' ELSE 'reject' END AS kind, o_orderdate
  AS decided_at FROM orders WHERE o_orderkey % 3 > 0)
SELECT decision_id, seq, CASE seq WHEN 0 THEN 'requested' WHEN 1 THEN 'evaluated' ELSE CASE kind WHEN 'reject' THEN 'rejected' WHEN 'queue_review' THEN 'queued'
  ELSE 'executed' END END AS event FROM d, (SELECT unnest([0, 1, 2]) AS seq)""")
def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of decisions; those of every third order were processed before, all are delivered twice."""
    o = table(spark, sf_dir, "orders")
    d = o.selectExpr(
        "o_orderkey AS decision_id",
        "CASE o_orderstatus WHEN 'F' THEN 'auto_merge' WHEN 'O' THEN 'queue_review' ELSE 'reject' END AS kind",
        "o_orderdate AS decided_at",
    )
    return events.decision_events(d.union(d), o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS decision_id")).select("decision_id", "seq", "event")


@query("""WITH a AS (SELECT l_orderkey AS decision_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, ['approve', 'reject',
  'execute'][1 + (l_partkey % 3)] AS action FROM lineitem),
l AS (SELECT decision_id, list(action ORDER BY n) AS s FROM a GROUP BY 1)
SELECT decision_id, CASE WHEN f IS NULL THEN 'pending' WHEN f = 'reject' THEN 'rejected' WHEN list_contains(s[p + 1:], 'execute') THEN 'executed' ELSE 'approved' END
  AS status, len(s) AS n_actions
FROM (SELECT decision_id, s, list_position(list_transform(s, lambda x: x IN ('approve', 'reject')), true) AS p, s[list_position(list_transform(s,
  lambda x: x IN ('approve', 'reject')), true)] AS f FROM l)""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items as folds of their actions."""
    from pyspark.sql import Window

    a = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("decision_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("at"),
        F.expr("element_at(array('approve', 'reject', 'execute'), CAST(1 + l_partkey % 3 AS INT)) AS action"),
    )
    return events.review_states(a)


_LOG = "log AS (SELECT user_id AS identity_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'disputed' WHEN 'click' THEN 'merged' ELSE 'split' END AS action FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS identity_id", "event_id AS seq", "ts AS at",
        "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'disputed' WHEN 'click' THEN 'merged' ELSE 'split' END AS action",
    )


@query(
    f"WITH {_LOG} SELECT identity_id, count(*) AS n_events, CASE arg_max(action, (epoch_us(ts), event_id)) WHEN 'promoted' THEN 'confirmed'"
    f" WHEN 'disputed' THEN 'disputed' WHEN 'merged' THEN 'merged' ELSE 'tentative' END AS status FROM log GROUP BY identity_id"
)
def event_fold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status that the log gives each identity."""
    return events.status_fold(_log(spark, sf_dir).withColumn("log", F.lit(0)))


@query(
    f"WITH {_LOG}, s AS (SELECT old, identity_id, CASE arg_max(action, (epoch_us(ts), event_id)) WHEN 'promoted' THEN 'confirmed' WHEN 'disputed' THEN 'disputed'"
    f" WHEN 'merged' THEN 'merged' ELSE 'tentative' END AS status, count(*) AS n FROM (SELECT *, true AS old FROM log WHERE event_id % 10 <> 1 UNION ALL SELECT *,"
    f" false FROM log WHERE identity_id % 7 > 0) GROUP BY old, identity_id) SELECT coalesce(a.identity_id, b.identity_id) AS identity_id, CASE"
    f" WHEN b.status IS NULL THEN 'only_a' WHEN a.status IS NULL THEN 'only_b' ELSE 'status' END AS difference FROM (SELECT * FROM s WHERE old) a FULL JOIN (SELECT *"
    f" FROM s WHERE NOT old) b USING (identity_id) WHERE a.status IS DISTINCT FROM b.status"
)
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state without every tenth event against one without every seventh identity."""
    log = _log(spark, sf_dir).withColumn("log", F.lit(0))
    state = lambda c: events.status_fold(log.where(c)).withColumn("confidence", F.lit(0.5))
    return events.state_differences(state("seq % 10 <> 1"), state("identity_id % 7 > 0")).select("identity_id", "difference")


@query("""WITH c AS (SELECT o_custkey AS id, (epoch_us(o_orderdate) // 1000000) * 100000000 + o_orderkey AS m, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END
  AS priority, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS deleted FROM orders),
g AS (SELECT id, max(m) FILTER (deleted) AS gone FROM c GROUP BY id) SELECT id, arg_max(priority, m) FILTER (priority IS NOT NULL) AS priority, arg_max(price,
  m) FILTER (price IS NOT NULL) AS price FROM c JOIN g USING (id) WHERE gone IS NULL OR m > gone GROUP BY id""")
def latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: partial updates and deletes as change rows, the state as their latest view."""
    c = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS id", "o_orderdate AS at", "o_orderkey AS seq",
        "IF(o_orderkey % 3 > 0, o_orderpriority, NULL) AS priority",
        "IF(o_orderkey % 2 = 0, o_totalprice, NULL) AS price",
        "o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS deleted",
    )
    return events.latest(c, ("id",), ("at", "seq"), ("priority", "price"))
