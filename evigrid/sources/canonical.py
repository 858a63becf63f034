"""The input tables read as canonical concepts.

An event is a piece of evidence: its user the investigation, its type the plugin and the
entity type, ``props.k`` the value. Users before and from ``SPLIT`` are drafts and known
identities. The types stand for signals as ``AS_TYPE`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.session import table

SPLIT = "2024-01-16"
#: Event type -> canonical entity type.
AS_TYPE = {"purchase": "email", "signup": "username", "click": "domain", "view": "display_name", "error": "language"}
#: The same events for DuckDB.
EV = "ev AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, CASE event_type WHEN 'purchase' THEN 'email' WHEN 'signup' THEN 'username' WHEN 'click' THEN 'domain' WHEN 'view' THEN 'display_name' ELSE 'language' END AS type FROM events)"


def as_type(c: Column) -> Column:
    out = F.lit("language")
    for k, v in AS_TYPE.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, user_id, event_type, k, value, type)``."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value", as_type(F.col("event_type")).alias("type"),
    )


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drafts (with their evidence, in seven independent groups) and known identities."""
    ev = evidence(spark, sf_dir).select(
        F.col("user_id").alias("identity"), "type", F.col("k").cast("string").alias("value"),
        (F.col("event_id") % 7).alias("evidence_id"), "ts",
    )
    return ev.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")), ev.where(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))
