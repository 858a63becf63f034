"""Risk scores, technique mapping and tags over evidence payloads.

Payloads are one row an investigation with a ``data`` VARIANT: plugin name -> payload.
A missing or wrongly typed field reads as null and a rule on it does not fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ports that count as risky.
RISKY_PORTS = (22, 23, 445, 3389, 5900, 6379, 27017, 9200)
INTEL = ("threatfox", "otx", "malwarebazaar", "urlscan", "virustotal", "opensanctions", "greynoise")


def get(path: str, kind: str) -> Column:
    return F.try_variant_get("data", f"$.{path}", kind)


def flag(path: str) -> Column:
    return F.coalesce(get(path, "boolean"), F.lit(False))


def items(path: str, kind: str = "string") -> Column:
    return F.coalesce(get(path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def present(path: str) -> Column:
    """Python's truth of a field: not missing, null, false, 0, '' , [] or {}."""
    text = F.to_json(F.try_variant_get("data", f"$.{path}", "variant"))
    return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _points() -> dict[str, Column]:
    n = lambda c, most, each: F.least(F.size(c), F.lit(most)) * each
    yes = lambda c, w: F.when(c, w).otherwise(0)
    risky = F.size(F.filter(items("shodan.all_open_ports", "int"), lambda p: p.isin(*RISKY_PORTS)))
    sub = F.coalesce(get("subdomains.total_found", "int"), F.size(items("subdomains.subdomains")))
    return {
        "reputation": n(items("reputation.threats"), 3, 8) + yes(flag("reputation.is_tor_exit"), 15),
        "vulnerabilities": n(items("shodan.all_vulns"), 3, 10),
        "exposure": risky * 5,
        "breach": yes(flag("breach.breach_found"), 12) + yes(flag("breach.credentials_leaked"), 20),
        "email": yes(flag("email.blacklisted"), 15) + yes(flag("email.disposable"), 6) + yes(flag("email.malicious_activity"), 18),
        "anonymization": yes(flag("ip_geo.is_proxy"), 10),
        "attack_surface": yes(sub > 50, 8),
        "tls": yes(present("ssl_analysis.issues"), 5),
        "intel": sum((yes(present(f"{s}.malicious") | present(f"{s}.found") | present(f"{s}.matches"), 15) for s in INTEL), F.lit(0)),
    }


def threat_scores(payloads: DataFrame) -> DataFrame:
    """``(investigation_id, score, level, tlp, categories, stages)``."""
    points = _points()
    df = payloads.select("investigation_id", "data", *(F.coalesce(v, F.lit(0)).cast("int").alias(f"p_{k}") for k, v in points.items()))
    score = F.least(sum((F.col(f"p_{k}") for k in points), F.lit(0)), F.lit(100))
    threats, leaked = F.size(items("reputation.threats")) > 0, flag("breach.credentials_leaked")
    sub = F.coalesce(get("subdomains.total_found", "int"), F.size(items("subdomains.subdomains")))
    stages = F.array_compact(
        F.array(
            F.when(sub > 0, "Reconnaissance"),
            F.when((F.col("p_vulnerabilities") > 0) | (F.col("p_exposure") > 0), "Weaponization"),
            F.when(flag("email.malicious_activity") | threats, "Delivery"), F.when(leaked, "Exploitation"),
            F.when(flag("reputation.is_tor_exit") | flag("ip_geo.is_proxy"), "Command and Control"),
        )
    )
    out = df.withColumn("score", score).withColumn("stages", F.when(F.size(stages) == 0, F.array(F.lit("Reconnaissance"))).otherwise(stages))
    level = F.when(F.col("score") >= 75, "CRITICAL").when(F.col("score") >= 50, "HIGH").when(F.col("score") >= 25, "MEDIUM").otherwise("LOW")
    tlp = F.when(F.col("score") >= 75, "RED").when(F.col("score") >= 25, "AMBER").otherwise("GREEN")
    return out.select(
        "investigation_id", "score", level.alias("level"), tlp.alias("tlp"),
        F.array_compact(F.array(*(F.when(F.col(f"p_{k}") > 0, k) for k in points))).alias("categories"),
        "stages",
    )


#: What to do about what a score is made of, in this order; ``none`` if nothing else applies.
ADVICE = {
    "isolate": "Cut the target off from production and call in incident response.",
    "patch": "Patch or shield the vulnerable services.",
    "close_ports": "Close the risky ports or restrict who reaches them.",
    "reset_passwords": "Reset the passwords of affected accounts and require a second factor.",
    "block_disposable": "Refuse disposable mail domains at registration.",
    "audit_subdomains": "Look for forgotten subdomains and remove those that are not used.",
    "watch_traffic": "Watch for traffic from proxies and Tor.",
    "none": "Nothing urgent; keep monitoring.",
}


def recommendations(payloads: DataFrame) -> DataFrame:
    """``(investigation_id, place, advice, text, about)``: a row for each recommendation in its order; ``about``
    names up to five vulnerabilities, or the risky ports."""
    scored = threat_scores(payloads).select("investigation_id", "level")
    vulns, ports = items("shodan.all_vulns"), F.filter(items("shodan.all_open_ports", "int"), lambda p: p.isin(*RISKY_PORTS))
    sub = F.coalesce(get("subdomains.total_found", "int"), F.size(items("subdomains.subdomains")), F.lit(0))
    none = F.lit(None).cast("string")
    rules = (
        ("isolate", F.col("level") == "CRITICAL", none), ("patch", F.size(vulns) > 0, F.array_join(F.slice(vulns, 1, 5), ", ")),
        ("close_ports", F.size(ports) > 0, F.array_join(ports.cast("array<string>"), ", ")), ("reset_passwords", flag("breach.credentials_leaked"), none),
        ("block_disposable", flag("email.disposable"), none), ("audit_subdomains", sub > 50, none), ("watch_traffic", flag("reputation.is_tor_exit") | flag("ip_geo.is_proxy"), none),
    )
    row = lambda k, about: F.struct(F.lit(k).alias("advice"), F.lit(ADVICE[k]).alias("text"), about.alias("about"))
    some = F.array_compact(F.array(*(F.when(c, row(k, about)) for k, c, about in rules)))
    given = payloads.join(scored, "investigation_id").select("investigation_id", F.explode(F.array(some)).alias("all"))
    every = F.when(F.size("all") == 0, F.array(row("none", none))).otherwise(F.col("all"))
    return given.select("investigation_id", F.posexplode(every).alias("place", "r")).select("investigation_id", "place", "r.*")


def threat_levels(evidence: DataFrame) -> DataFrame:
    """The other scale: ``(investigation_id, points, level)`` from one row a plugin with ``success`` and ``data``."""
    at = lambda p, c: F.when((F.col("plugin_name") == p) & F.col("success"), c).otherwise(0)
    yes = lambda path, w: F.when(F.coalesce(F.try_variant_get("data", f"$.{path}", "boolean"), F.lit(False)), w).otherwise(0)
    n = lambda path: F.coalesce(F.least(F.size(F.try_variant_get("data", f"$.{path}", "array<string>")), F.lit(3)), F.lit(0))
    points = at(
        "reputation", F.greatest(n("threats"), F.lit(0)) + yes("is_tor_exit", 2),
    ) + at("shodan", F.greatest(n("all_vulns"), F.lit(0))) + at("breach", yes("breach_found", 1) + yes("credentials_leaked", 2)) + at("ip_geo", yes("is_proxy", 2)) + at("email", yes("disposable", 1) + yes("blacklisted", 2))
    total = evidence.groupBy("investigation_id").agg(F.sum(points).alias("points"))
    return total.withColumn("level", F.when(F.col("points") >= 5, "CRITICAL").when(F.col("points") >= 3, "HIGH").when(F.col("points") >= 1, "MEDIUM").otherwise("LOW"))


# Techniques (id, name, tactic) that the rules below can find.
TECHNIQUES = (
    ("T1090.003", "Tor Routing", "Command and Control"), ("T1090", "Proxy", "Command and Control"), ("T1046", "Network Service Discovery", "Discovery"), ("T1071.001", "Web Protocols", "Command and Control"), ("T1071.004", "DNS", "Command and Control"), (
        "T1133", "External Remote Services", "Initial Access, Persistence",
    ),
    ("T1190", "Exploit Public-Facing Application", "Initial Access"), ("T1566.002", "Spearphishing Link", "Initial Access"), ("T1583.001", "Domains", "Resource Development"), (
        "T1078", "Valid Accounts", "Defense Evasion, Persistence, Privilege Escalation, Initial Access",
    ), ("T1592.002", "Software", "Reconnaissance"), ("T1595.001", "Scanning IP Blocks", "Reconnaissance"),
)


def techniques(payloads: DataFrame) -> DataFrame:
    """``(investigation_id, technique_id, name, tactic, source)``, each technique once, by its first rule."""
    ports = items("shodan.all_open_ports", "int")
    any_port = lambda *p: F.exists(ports, lambda x: x.isin(*p))
    threat = lambda word: F.exists(items("reputation.threats"), lambda t: F.contains(F.lower(t), F.lit(word)))
    title = F.lower(F.coalesce(get("http.title", "string"), F.lit("")))
    rules = (
        ("T1090.003", "reputation", flag("reputation.is_tor_exit")), ("T1090", "reputation", threat("proxy") | threat("vpn")), ("T1046", "shodan", F.size(ports) > 0), ("T1071.001", "shodan", any_port(80, 443, 8080)), ("T1071.004", "shodan", any_port(53)), ("T1133", "shodan", any_port(22, 3389)),
        ("T1190", "shodan", F.size(items("shodan.all_vulns")) > 0), ("T1566.002", "http", title.rlike("login|verify|secure|account")), ("T1583.001", "subdomains", F.size(items("subdomains.subdomains")) > 5), ("T1078", "breach", flag("breach.credentials_leaked")), ("T1592.002", "technology", present("technology.technologies")), (
            "T1595.001", "certs", F.coalesce(get("certs.total_certs", "int") > 50, F.lit(False)),
        ),
    )
    known = {t: (n, k) for t, n, k in TECHNIQUES}
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(t).alias("technique_id"), F.lit(known[t][0]).alias("name"), F.lit(known[t][1]).alias("tactic"), F.lit(s).alias("source"))) for t, s, c in rules)))
    return payloads.select("investigation_id", F.inline(each))


def risk_matrix(found: DataFrame) -> DataFrame:
    """``(technique_id, tactic, n_sources, severity, rank)`` over all investigations."""
    per = found.groupBy("technique_id", "tactic").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("investigation_id").alias("n_investigations"))
    n = F.col("n_sources")
    severity = F.when(n >= 3, "critical").when(n >= 2, "high").when(n == 1, "medium").otherwise("low")
    return per.withColumn("severity", severity).withColumn("rank", F.when(n >= 3, 0).when(n >= 2, 1).when(n == 1, 2).otherwise(3))


def tags(payloads: DataFrame) -> DataFrame:
    """``(investigation_id, tag)`` for each tag whose rule fires, in rule order."""
    title = F.lower(F.coalesce(get("http.title", "string"), F.lit("")))
    threats = F.lower(F.array_join(items("reputation.threats"), ","))
    rules = (
        ("tor", present("reputation.is_tor_exit")), ("proxy", present("ip_geo.is_proxy")), ("vpn", F.contains(threats, F.lit("vpn"))), ("breached", present("breach.breach_found")), ("credentials-leaked", present("breach.credentials_leaked")), ("disposable-email", present("email.disposable")), ("blacklisted", present("email.blacklisted")),
        ("vulnerable", present("shodan.all_vulns")), ("exposed-ports", present("shodan.all_open_ports")), ("subdomain-sprawl", F.size(items("subdomains.subdomains")) > 20), ("cdn-hosted", present("ip_geo.is_hosting")), (
            "new-domain",
            F.contains(F.substr(F.coalesce(get("whois.creation_date", "string"), F.lit("")), F.lit(1), F.lit(5)), F.lit("202")),
        ), ("sanctions-hit", present("opensanctions.matches")), ("threatfox-listed", present("threatfox.matches")),
        ("otx-flagged", present("otx.indicators")), ("malware-associated", present("malwarebazaar.samples")), (
            "phishing-suspected",
            F.contains(threats, F.lit("phish")) | title.rlike("login|verify|account|secure"),
        ), ("c2-suspected", present("cobaltstrike.detected") | present("jarm.c2_match")), ("ssl-misconfigured", present("ssl_analysis.issues")), ("has-cve", present("shodan.all_vulns")), ("high-entropy", present("secret_scanner.secrets_found")), ("ico-or-sto", present("cryptoscamdb.matches")),
    )
    return payloads.select("investigation_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules)))).alias("tag"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """``(*keys, metric, added, removed)``: set differences of two snapshots in long form."""
    side = lambda df, n: df.select(*keys, metric, value).distinct().withColumn(n, F.lit(True))
    both = side(old, "_old").join(side(new, "_new"), [*keys, metric, value], "full_outer")
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col(value))))
    out = both.groupBy(*keys, metric).agg(pick("_old").alias("added"), pick("_new").alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def fingerprint(metrics: DataFrame, keys: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """``(*keys, fingerprint)``: sha256 of the sorted distinct ``metric=value`` pairs."""
    pairs = F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", metric, value))), ";")
    return metrics.groupBy(*keys).agg(F.sha2(pairs, 256).alias("fingerprint"))


def integrity_drift(evidence: DataFrame, custody: DataFrame) -> DataFrame:
    """Evidence whose digest is not the latest recorded one: ``(evidence_id, recorded, now, intact)``."""
    last = custody.groupBy("evidence_id").agg(F.max_by("sha256", F.struct("recorded_at", "sha256")).alias("recorded"))
    return evidence.select("evidence_id", F.sha2("payload", 256).alias("now")).join(last, "evidence_id", "left").withColumn(
        "intact", F.coalesce(F.col("recorded") == F.col("now"), F.lit(False)),
    )
