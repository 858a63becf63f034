"""Typed entities in free text: one pass of regular expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pattern of each entity type, in order of precedence.
PATTERNS = {
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b",
    "url": r"(?i)\bhttps?://[^\s<>'\"{}|\\^`]+",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "cve": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "asn": r"\bAS\d{1,10}\b",
    "btc": r"\b(?:bc1[a-zA-HJ-NP-Z0-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "eth": r"\b0x[a-fA-F0-9]{40}\b",
    "cidr": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2}\b",
    "port": r"(?i)\bport[ _-]?\d{1,5}\b",
    "useragent": r"\b(?:Mozilla|curl|wget|python-requests)/[\d.]+[^\s]*",
    "phone_e164": r"\+\d{6,15}\b",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
}
#: What every match of a type contains (one of these; of types that ignore case, in lower case). Looking for
#: it costs far less than the pattern, which most texts are spared.
NEEDS = {
    "ipv4": (".",), "ipv6": (":",), "domain": (".",), "url": ("://",), "email": ("@",), "cve": ("cve-",), "asn": ("AS",), "eth": ("0x",), "cidr": ("/",), "port": ("port",),
    "useragent": ("Mozilla/", "curl/", "wget/", "python-requests/"), "phone_e164": ("+",), "mac": (":", "-"),
}
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "yourdomain.com", "domain.com")
CONTEXT = 40


def matches(text: Column, kind: str) -> Column:
    """Distinct matches of one type, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0))
    if kind in NEEDS:
        inside = F.lower(text) if PATTERNS[kind].startswith("(?i)") and kind != "url" else text
        some = F.lit(False)
        for part in NEEDS[kind]:
            some = some | F.contains(inside, F.lit(part))
        found = F.when(some, found).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda v: ~F.lower(v).isin(*PLACEHOLDER_DOMAINS)) if kind == "domain" else found


def entities(df: DataFrame, text: str, key: list[str], kinds: tuple[str, ...] = tuple(PATTERNS), context: bool = True) -> DataFrame:
    """``(*key, type, value, rank, pos, context)`` of every entity of every text; a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = lambda n, k: lambda v, i: F.struct(F.lit(k).alias("type"), v.alias("value"), F.lit(n).alias("rank"), i.alias("pos"))
    each = F.flatten(F.array(*(F.transform(matches(t, k), named(n, k)) for n, k in enumerate(kinds))))
    out = df.select(*key, F.col(text).alias("_t"), F.inline(each)) if context else df.select(*key, F.inline(each))
    if not context:
        return out
    at = F.instr("_t", F.col("value"))
    start = F.greatest(at - CONTEXT, F.lit(1))
    return out.withColumn("context", F.substr("_t", start, at - start + F.length("value") + CONTEXT)).drop("_t")


def first_by_value(found: DataFrame, key: list[str]) -> DataFrame:
    """Keeps, per key, the first entity of each (type, value) whatever its case."""
    w = Window.partitionBy(*key, "type", F.lower("value")).orderBy("rank", "pos", "value")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Kinds of targets that are entities themselves.
TARGETS = ("domain", "url", "ip", "email", "username", "phone", "mac", "crypto")


def with_target(found: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, type, value, source, confidence)``: the first entity of each (type, value) whatever its case, at
    75, and the investigation's target at 100, which takes the place of an equal entity.

    ``targets`` has the key, ``target`` and ``target_type``; a crypto target counts as an address of that
    kind, and targets of kinds that have no pattern (but user names) are not added.
    """
    kind = F.when(F.col("target_type") == "crypto", "btc").otherwise(F.col("target_type"))
    own = targets.where(F.col("target_type").isin(*TARGETS)).select(*key, kind.alias("type"), F.col("target").alias("value")).where(F.col("type").isin(*PATTERNS, "username"))
    rows = first_by_value(found, key).select(*key, "type", "value", F.lit("regex").alias("source"), F.lit(75).alias("confidence"))
    both = rows.union(own.select(*key, "type", "value", F.lit("target"), F.lit(100)))
    best = F.max_by(F.struct("value", "source", "confidence"), "confidence").alias("b")
    return both.groupBy(*key, "type", F.lower("value").alias("_v")).agg(best).select(*key, "type", "b.*")
