"""What single evidence sources compute from their payloads."""

from __future__ import annotations

import graphlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ports that count as risky.
RISKY_PORTS = (21, 22, 23, 25, 445, 1433, 3306, 3389, 5432, 5900, 6379, 9200, 27017)


def snapshots_by_month(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """``(key, first, last, n_months)`` of archive stamps ``YYYYMMDD...``; order is that of the text."""
    return df.groupBy(key).agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.countDistinct(F.substring(stamp, 1, 6)).alias("n_months"))


def earliest_signal(df: DataFrame, key: str) -> DataFrame:
    """``(key, date, source)``: the earliest date and the first source that has it, of ``(key, source, date, pos)``."""
    return df.where("date IS NOT NULL").groupBy(key).agg(F.min("date").alias("date"), F.min_by("source", F.struct("date", "pos")).alias("source"))


def breach_timeline(df: DataFrame, key: str) -> DataFrame:
    """``(key, dates, worst, kinds)`` of ``(key, date, severity, kinds)``: undated breaches come first."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    at = F.coalesce("date", F.lit("0000-00-00"))
    return df.groupBy(key).agg(
        F.array_sort(F.collect_list(at)).alias("dates"), F.max_by("severity", rank).alias("worst"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
    )


def subdomains(found: DataFrame, root: str, name: str, most: int = 200) -> DataFrame:
    """``(root, subdomains, total)``: names of all sources under their root, normal and sorted, the first ``most``."""
    n = F.regexp_replace(F.lower(F.trim(F.col(name))), r"^[*.]+", "")
    rows = found.select(root, n.alias("n")).where(F.col("n").endswith(F.concat(F.lit("."), F.col(root)))).distinct()
    w = Window.partitionBy(root).orderBy("n")
    top = rows.withColumn("p", F.row_number().over(w))
    return top.groupBy(root).agg(F.array_sort(F.collect_list(F.when(F.col("p") <= most, F.col("n")))).alias("subdomains"), F.count("*").alias("total"))


def ports(df: DataFrame, key: str, port: str) -> DataFrame:
    """``(key, ports, risky)``: the union of what all sources saw open."""
    p = F.array_sort(F.collect_set(port))
    return df.groupBy(key).agg(p.alias("ports")).withColumn("risky", F.array_intersect("ports", F.array(*map(F.lit, RISKY_PORTS))))


def robots(body: Column) -> Column:
    """Disallowed, allowed and sitemap lines of a robots file (first 50, 50 and 10) and their counts."""
    lines = lambda k: F.regexp_extract_all(body, F.lit(rf"(?im)^{k}:[ \t]*(\S+)"), 1)
    d, a, s = lines("Disallow"), lines("Allow"), lines("Sitemap")
    return F.struct(
        F.slice(d, 1, 50).alias("disallow"), F.slice(a, 1, 50).alias("allow"),
        F.slice(s, 1, 10).alias("sitemaps"), F.size(d).alias("n_disallow"), F.size(a).alias("n_allow"),
    )


def certificates(names: Column) -> Column:
    """Names of a certificate list: one a line, wild cards off, sorted, the first 50."""
    each = F.transform(F.split(F.lower(names), "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[*.]+", ""))
    return F.slice(F.array_sort(F.array_distinct(F.filter(each, lambda x: x != ""))), 1, 50)


def tls(not_after: Column, now: Column) -> Column:
    left = F.datediff(not_after, now)
    return F.struct(left.alias("days_remaining"), (left < 0).alias("expired"), ((left >= 0) & (left <= 30)).alias("expires_soon"))


def adapter_observations(df: DataFrame, key: str, payload: str, most: int = 512) -> DataFrame:
    """``(key, observation_type, value)``: one observation for each scalar top-level field; nested ones are left out."""
    each = df.select(key, F.explode(F.from_json(payload, "map<string,string>")).alias("k", "value"))
    return each.where("value IS NOT NULL AND NOT (value LIKE '{%' OR value LIKE '[%')").select(
        key, F.concat(F.lit("field:"), "k").alias("observation_type"),
        F.substring("value", 1, most).alias("value"),
    )


def followups(found: DataFrame, key: str, limits: dict[str, int], confidence: int = 70) -> DataFrame:
    """New entities ``(key, type, value, confidence)`` that sources yield: the first few of each type
    in their order, each value once whatever its case. ``found`` has ``(key, type, value, pos)``."""
    rank = F.row_number().over(Window.partitionBy(key, "type").orderBy("pos"))
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    kept = found.withColumn("p", rank).where(F.col("p") <= F.coalesce(F.try_element_at(most, F.col("type")), F.lit(1 << 30)))
    once = Window.partitionBy(key, "type", F.lower("value")).orderBy("pos")
    return kept.withColumn("q", F.row_number().over(once)).where("q = 1").select(key, "type", "value", F.lit(confidence).alias("confidence"))


def levels(needs: dict[str, set[str]]) -> dict[str, int]:
    """Level of each source: one more than the highest of those it needs. A cycle is an error."""
    out: dict[str, int] = {}
    for name in graphlib.TopologicalSorter(needs).static_order():
        out[name] = 1 + max((out[x] for x in needs.get(name, ())), default=-1)
    return out
