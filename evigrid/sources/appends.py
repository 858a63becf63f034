"""Append-only tables: evidence, extracted entities, audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an entity's context that are stored.
MOST_CONTEXT = 500


def evidence(results: DataFrame, path: str) -> None:
    """Appends plugin results, one a row, by day of collection."""
    results.withColumn("day", F.to_date("collected_at")).write.mode("append").partitionBy("day").parquet(path)


def entities(found: DataFrame, path: str) -> None:
    """Appends extracted entities; a longer context is cut."""
    found.withColumn("context", F.substring("context", 1, MOST_CONTEXT)).write.mode("append").parquet(path)


def log(lines: DataFrame, path: str) -> None:
    """Appends log lines ``(at, level, message)`` by day; a line without a level is of level info."""
    rows = lines.withColumn("level", F.lower(F.coalesce("level", F.lit("info")))).withColumn("day", F.to_date("at"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """What was appended; ``since`` prunes days."""
    df = spark.read.parquet(path)
    return df if since is None else df.where(F.col("day") >= F.lit(since).cast("date"))


def snapshot_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of captured pages: digest, size and time as a payload, without the body."""
    body = F.encode("html", "UTF-8")
    facts = F.struct(F.sha2(body, 256).alias("sha256"), F.octet_length(body).alias("size_bytes"), F.col("url"))
    return pages.select("investigation_id", F.lit("snapshot").alias("plugin_name"), F.to_json(facts).alias("raw"))
