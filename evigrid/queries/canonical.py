"""Ingestion and identity operators over events as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import identity, ingest
from evigrid.operators.correlate import noisy_or
from evigrid.plans.lineage import written
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources.canonical import EV, evidence


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select(
        "type", F.col("k").cast("string").alias("normalized_value"),
        F.concat(F.lit(" "), "k").alias("raw_value"), F.col("ts").alias("seen_at"),
        F.col("user_id").alias("investigation_id"), F.col("event_id").alias("seq"),
    )


@query(
    f"WITH {EV} SELECT type, k::VARCHAR AS normalized_value, ' ' || k AS raw_value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS source_count,"
    f" count(DISTINCT user_id) AS investigation_count FROM ev GROUP BY type, k"
)
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch into an empty store."""
    return ingest.upserted_entities(_seen(spark, sf_dir))


@query(
    f"WITH {EV} SELECT type, k::VARCHAR AS normalized_value, ' ' || k AS raw_value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS source_count,"
    f" count(DISTINCT user_id) AS investigation_count FROM ev GROUP BY type, k"
)
def entity_upsert_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of ten days, each onto the entities and links that those before it left."""
    seen, entities, links = _seen(spark, sf_dir), None, None
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    at = F.col("seen_at")
    for batch in (at < day(11), (at >= day(11)) & (at < day(21)), at >= day(21)):
        entities, links = (written(df, "store") for df in ingest.ingested(seen.where(batch), entities, links))
    return entities


@query(f"WITH {EV} SELECT DISTINCT sha256(type || chr(1) || k) AS entity_id, user_id AS investigation_id FROM ev")
def entity_investigation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I14, with ids made from content."""
    return evidence(spark, sf_dir).select(
        ingest.entity_id(F.col("type"), F.col("k").cast("string")).alias("entity_id"),
        F.col("user_id").alias("investigation_id"),
    ).distinct()


@query(
    f"WITH {EV}, l AS (SELECT DISTINCT type, k, user_id FROM ev) SELECT a.type AS type_a, a.k AS k_a, b.type AS type_b, b.k AS k_b, count(*) AS n_shared FROM l a"
    f" JOIN l b ON a.user_id = b.user_id AND a.type = 'email' AND b.type = 'username' GROUP BY ALL HAVING count(*) >= 2"
)
def shared_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and username entities that two investigations or more share."""
    links = evidence(spark, sf_dir).select("type", "k", "user_id").distinct()
    side = lambda t, n: links.where(F.col("type") == t).select(F.col("type").alias(f"type_{n}"), F.col("k").alias(f"k_{n}"), "user_id")
    return side("email", "a").join(side("username", "b"), "user_id").groupBy("type_a", "k_a", "type_b", "k_b").agg(F.count("*").alias("n_shared")).where("n_shared >= 2")


@query(
    "SELECT s.s_nationkey AS source_id, l_suppkey AS target_id, l_returnflag AS relationship_type, max(l_discount) AS confidence, min(l_shipdate) AS first_seen,"
    " max(l_shipdate) AS last_seen, count(*) AS n_seen FROM lineitem JOIN supplier s ON l_suppkey = s_suppkey GROUP BY ALL"
)
def relationship_upsert_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: nation to supplier edges seen in line items."""
    seen = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ingest.upserted_relationships(
        seen.select(
            F.col("s_nationkey").alias("source_id"), F.col("l_suppkey").alias("target_id"),
            F.col("l_returnflag").alias("relationship_type"), F.col("l_discount").alias("confidence"),
            F.col("l_shipdate").alias("observed_at"),
        )
    )


@query(
    "SELECT l_suppkey AS relationship_id, l_orderkey AS evidence_id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (l_partkey % 3 > 0)"
    " AS observation_id FROM lineitem GROUP BY ALL"
)
def provenance_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, order) pairs, with the first observation that has an id."""
    return ingest.provenance(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").alias("relationship_id"), F.col("l_orderkey").alias("evidence_id"),
            F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).alias("observation_id"),
            (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("seq"),
        )
    )


@query(
    "SELECT DISTINCT o_custkey AS investigation_id, o_orderkey AS evidence_id, l_suppkey AS entity_id, o_orderdate AS collected_at FROM orders"
    " JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey"
)
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, its observations and their entities, once each."""
    o, li, s = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    return ingest.evidence_chain(
        o.selectExpr("o_custkey AS investigation_id", "o_orderkey AS evidence_id", "o_orderdate AS collected_at"),
        li.selectExpr("l_orderkey AS evidence_id", "l_suppkey AS entity_id"), s.selectExpr("s_suppkey AS entity_id"),
    ).select("investigation_id", "evidence_id", "entity_id", "collected_at")


@query(
    "SELECT l_suppkey AS relationship_id, list_sort(list(DISTINCT l_returnflag)) AS plugins, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,"
    " count(DISTINCT l_orderkey) AS n_evidence FROM lineitem GROUP BY l_suppkey"
)
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plugins, time range and evidence behind each relationship."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("relationship_id")).agg(
        F.sort_array(F.collect_set("l_returnflag")).alias("plugins"), F.min("l_shipdate").alias("first_seen"),
        F.max("l_shipdate").alias("last_seen"), F.countDistinct("l_orderkey").alias("n_evidence"),
    )


@query(
    f"WITH {EV} SELECT user_id AS execution_id, event_type AS plugin_id, min(event_id) AS evidence_id FROM ev WHERE (user_id, event_type) NOT IN (SELECT user_id,"
    f" event_type FROM ev WHERE ts < TIMESTAMP '2024-01-03') GROUP BY ALL"
)
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9, ST7: evidence of executions that the store (the first two days) does not have."""
    ev = evidence(spark, sf_dir).select(F.col("user_id").alias("execution_id"), F.col("event_type").alias("plugin_id"), F.col("event_id").alias("evidence_id"), "ts")
    stored = ev.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"))
    return ingest.new_only(ev, stored).drop("ts")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).selectExpr(
        "event_id", "IF(event_id % 11 = 0, 2, 1) AS schema_version", "event_type AS plugin_id", "IF(event_id % 13 = 0, ' ', '1') AS plugin_version", "CAST(k AS STRING) AS target", "IF(event_id % 17 = 0, NULL, type) AS target_type", "ts AS executed_at",
        "IF(event_id % 19 = 0, 'x', NULL) AS investigation_id", "IF(value > 90, 1.5D, 0.5D) AS confidence",
        "array(named_struct('type', IF(type = 'language', 'language', type), 'raw_value', IF(k % 5 = 0, '', CAST(k AS STRING)), 'normalized_value', '', 'confidence',"
        " 0.5D, 'context', '')) AS entities",
        "array(named_struct('source_entity_type', type, 'source_entity_value', CAST(k AS STRING), 'target_entity_type', type, 'target_entity_value', CAST(k % 7"
        " AS STRING), 'relationship_type', IF(user_id % 3 = 0, 'x-near', IF(user_id % 3 = 1, 'owns', 'hates')), 'confidence', 0.5D)) AS relationships",
        "array(named_struct('observation_type', event_type, 'value', IF(k % 4 = 0, NULL, 'v'), 'confidence', IF(event_id % 23 = 0, -1D, 1D), 'linked_entity_type',"
        " type, 'linked_entity_value', CAST(k AS STRING))) AS observations",
    )


@query(f"""WITH {EV} SELECT event_id, list_filter(['schema_version:version' , 'plugin_version:required', 'target_type:required', 'executed_at:future',
  'investigation_id:uuid', 'confidence:range', 'entities[0].type:unknown_type', 'entities[0].raw_value:empty', 'relationships[0].relationship_type:unknown_type',
  'relationships[0]:self_loop', 'observations[0].value:empty', 'observations[0].confidence:range'],
 lambda e: CASE e WHEN 'schema_version:version' THEN event_id % 11 = 0 WHEN 'plugin_version:required' THEN event_id % 13 = 0
  WHEN 'target_type:required' THEN event_id % 17 = 0 WHEN 'executed_at:future' THEN ts > TIMESTAMP '2024-01-28 00:05:00'
  WHEN 'investigation_id:uuid' THEN event_id % 19 = 0 WHEN 'confidence:range' THEN value > 90
 WHEN 'entities[0].type:unknown_type' THEN type IN ('language', 'display_name') WHEN 'entities[0].raw_value:empty' THEN k % 5 = 0 WHEN 'relationships[0].relationship_type:unknown_type' THEN user_id % 3 = 2 WHEN 'relationships[0]:self_loop' THEN k = k % 7 WHEN 'observations[0].value:empty' THEN k % 4 = 0 ELSE event_id % 23 = 0 END) AS errors,
 len(list_filter([k % 5 = 0], lambda x: x)) AS n_warnings FROM ev""")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every envelope, with its path and code."""
    found = ingest.validated(_envelopes(spark, sf_dir), F.lit("2024-01-28").cast("timestamp_ntz"))
    return found.select(
        "event_id", F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])).alias("errors"),
        F.size("warnings").cast("long").alias("n_warnings"),
    )


@query(f"WITH {EV} SELECT event_id, type, k::VARCHAR AS normalized_value, coalesce(type, '') AS target_type FROM ev WHERE type <> 'x'")
def sanitize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms inside the envelope."""
    raw = _envelopes(spark, sf_dir).withColumn(
        "entities",
        F.transform("entities", lambda e: e.withField("raw_value", F.concat(F.lit(" "), "target", F.lit(" ")))),
    ).withColumn("target_type", F.upper(F.col("entities")[0]["type"]))
    done = ingest.sanitized(raw)
    return done.select("event_id", F.col("entities")[0]["type"].alias("type"), F.col("entities")[0]["normalized_value"].alias("normalized_value"), "target_type")


@query(f"WITH {EV} SELECT type, k, count(DISTINCT (event_type, user_id % 5)) AS n_sources FROM ev GROUP BY type, k")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (plugin, source) pairs behind each entity."""
    return evidence(spark, sf_dir).groupBy("type", "k").agg(F.countDistinct(F.struct("event_type", F.col("user_id") % 5)).alias("n_sources"))


@query(
    f"WITH {EV}, w AS (SELECT user_id, event_id % 7 AS e, max(least(1, greatest(0, value / 1000))) AS w FROM ev GROUP BY ALL) SELECT user_id,"
    f" round(1 - product(1 - w), 6) AS confidence FROM w GROUP BY user_id"
)
def noisy_or_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest signal of each piece of evidence, combined."""
    strongest = evidence(spark, sf_dir).groupBy("user_id", F.col("event_id") % 7).agg(F.max(F.col("value") / 1000).alias("w"))
    return strongest.groupBy("user_id").agg(F.round(noisy_or(F.col("w")), 6).alias("confidence"))


@query(f"""WITH {EV}, m AS (SELECT user_id, type, k, count(DISTINCT event_id % 5) AS n FROM ev GROUP BY ALL),
w AS (SELECT user_id, CASE WHEN type = 'email' THEN 0.85 ELSE least(1.0, (CASE type WHEN 'username' THEN 0.5 ELSE 0.2 END) * (1 + ln(n))) END AS w FROM m)
SELECT user_id AS identity_id, round(1 - product(1 - w), 6) AS confidence, CASE WHEN round(1 - product(1 - w), 6) >= 0.85 THEN 'confirmed' ELSE 'tentative' END AS status
  FROM w GROUP BY user_id""")
def log_damped_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and promotion of identities."""
    m = evidence(spark, sf_dir).groupBy(F.col("user_id").alias("identity_id"), "type", "k").agg(F.countDistinct(F.col("event_id") % 5).alias("n_sources"))
    return identity.confidence(m)


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT DISTINCT user_id % 10 AS inv, event_id // 4 AS evid, type || ':' || k AS ent, type FROM ev),
s AS (SELECT inv, evid FROM o WHERE type = 'email' GROUP BY ALL), e AS (SELECT DISTINCT a.inv, a.ent AS x, b.ent AS y FROM o a JOIN s USING (inv, evid) JOIN o b USING (inv, evid)),
r AS (SELECT inv, ent, ent AS root FROM (SELECT DISTINCT inv, ent FROM o) UNION SELECT r.inv, e.y, r.root FROM r JOIN e ON r.inv = e.inv AND r.ent = e.x)
SELECT inv AS investigation_id, ent AS entity_id, min(root) AS cluster FROM r GROUP BY inv, ent""")
def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities linked by evidence with a strong identifier, within each investigation."""
    o = evidence(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("investigation_id"),
        F.floor(F.col("event_id") / 4).alias("evidence_id"), F.concat_ws(":", "type", "k").alias("entity_id"),
        "type",
    ).distinct()
    return identity.clusters(o).withColumn("cluster", F.split_part("cluster", F.lit("\x01"), F.lit(2)))


_LINKS = f"WITH {EV}, links AS (SELECT DISTINCT user_id AS identity_id, type || ':' || k AS entity_id FROM ev WHERE ts < TIMESTAMP '2024-01-16'), wanted AS (SELECT DISTINCT user_id AS candidate, type || ':' || k AS entity_id FROM ev WHERE ts >= TIMESTAMP '2024-01-16')"


def _links(spark: SparkSession, sf_dir: str, owner: Column | None = None) -> tuple[DataFrame, DataFrame]:
    ev, cut = evidence(spark, sf_dir).withColumn("entity_id", F.concat_ws(":", "type", "k")), F.lit("2024-01-16").cast("timestamp_ntz")
    user = F.col("user_id")
    side = lambda rows, of, name: rows.select(of.alias(name), "entity_id").distinct()
    return side(ev.where(F.col("ts") < cut), user if owner is None else owner, "identity_id"), side(ev.where(F.col("ts") >= cut), user, "candidate")


@query(_LINKS + """, s AS (SELECT identity_id, count(*) AS n FROM links GROUP BY ALL), b AS (SELECT candidate, identity_id, count(*) AS n_shared FROM wanted
  JOIN links USING (entity_id) GROUP BY ALL)
SELECT candidate, identity_id, n_shared, share FROM (SELECT candidate, identity_id, n_shared, n_shared / n AS share, row_number() OVER (PARTITION BY candidate
  ORDER BY n_shared DESC, n_shared / n DESC, identity_id) AS p FROM b JOIN s USING (identity_id) WHERE n_shared / n >= 0.5 OR n_shared >= 2) WHERE p = 1""")
def legacy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored identity that overlaps most with each candidate."""
    links, wanted = _links(spark, sf_dir)
    return identity.best_overlap(wanted, links)


@query(_LINKS.replace("user_id AS identity_id", "user_id * 100 + day(ts) AS identity_id") + """, s AS (SELECT identity_id, count(*) AS n FROM links GROUP BY ALL), b AS (SELECT candidate, identity_id, count(*) AS m FROM wanted
  JOIN links USING (entity_id) GROUP BY ALL)
SELECT candidate, min(identity_id) AS identity_id FROM b JOIN s USING (identity_id) WHERE m = n GROUP BY candidate""")
def contained_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored identities (what one user showed on one day) whose entities are all in a candidate set."""
    links, wanted = _links(spark, sf_dir, F.col("user_id") * 100 + F.dayofmonth("ts"))
    return identity.contained_in(links, wanted)


@query(
    f"WITH {EV}, l AS (SELECT user_id AS i, type || ':' || k AS entity_id, max(value) AS w FROM ev GROUP BY ALL) SELECT CASE WHEN i % 10 = 3 THEN i - 1 ELSE i END"
    f" AS identity_id, entity_id, max(w) AS signal_weight FROM l GROUP BY ALL"
)
def merge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth identity is merged into its predecessor; the higher weight stays."""
    links = evidence(spark, sf_dir).groupBy(
        F.col("user_id").alias("identity_id"), F.concat_ws(":", "type", "k").alias("entity_id"),
    ).agg(F.max("value").alias("signal_weight"))
    merges = links.select(F.col("identity_id").alias("source_id"), (F.col("identity_id") - 1).alias("target_id")).where("source_id % 10 = 3").distinct()
    return identity.merged_links(links, merges)


@query(f"WITH {EV} SELECT user_id AS identity_id, 'e' || event_id AS entity_id, value AS signal_weight FROM ev")
def split_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting what was merged gives the links that were there before."""
    links = evidence(spark, sf_dir).select(
        F.col("user_id").alias("identity_id"), F.concat(F.lit("e"), "event_id").alias("entity_id"),
        F.col("value").alias("signal_weight"),
    )
    moved = links.where("identity_id % 10 = 3")
    merged = identity.merged_links(links, moved.select(F.col("identity_id").alias("source_id"), (F.col("identity_id") - 1).alias("target_id")).distinct())
    records = moved.groupBy(F.col("identity_id").alias("source_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("entity_id", "signal_weight"))).alias("moved")
    ).withColumn("target_id", F.col("source_id") - 1)
    return identity.split_links(merged, records)


@query(
    f"WITH {EV}, f AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 86400 PRECEDING"
    f" AND CURRENT ROW) AS n FROM ev WHERE event_type = 'error') SELECT user_id AS plugin_id, min(ts) FILTER (n >= 3) AS quarantined_at, max(n) AS n_failures FROM f"
    f" GROUP BY user_id HAVING max(n) >= 3"
)
def quarantine_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I24, ST5: plugins with three structural failures within a day."""
    return ingest.quarantined(evidence(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("plugin_id"), F.col("ts").alias("failed_at")))


@query(f"WITH {EV} SELECT user_id AS plugin_id, count(*) AS total, count(*) FILTER (event_type <> 'error') / count(*) AS rate FROM ev GROUP BY user_id")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I22, I25."""
    return evidence(spark, sf_dir).groupBy(F.col("user_id").alias("plugin_id")).agg(
        F.count("*").alias("total"),
        F.coalesce(F.try_divide(F.count_if(F.col("event_type") != "error"), F.count("*")), F.lit(0.0)).alias("rate"),
    )


@query(
    f"WITH {EV}, f AS (SELECT ['KeyError', 'TimeoutError', 'HTTPError', 'OSError'][1 + user_id % 4] AS kind, [429, 404, 503, 200][1 + k % 4] AS status FROM ev)"
    f" SELECT kind, status, CASE WHEN kind = 'KeyError' THEN 'structural' WHEN kind IN ('TimeoutError', 'OSError') OR status IN (429, 503) THEN 'transient'"
    f" ELSE 'structural' END AS failure, count(*) AS n FROM f GROUP BY ALL"
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I23."""
    f = evidence(spark, sf_dir).selectExpr(
        "element_at(array('KeyError', 'TimeoutError', 'HTTPError', 'OSError'), CAST(1 + user_id % 4 AS INT)) AS kind",
        "element_at(array(429, 404, 503, 200), CAST(1 + k % 4 AS INT)) AS status",
    )
    return f.withColumn("failure", ingest.failure_class(F.col("kind"), F.col("status"))).groupBy("kind", "status", "failure").agg(F.count("*").alias("n"))
