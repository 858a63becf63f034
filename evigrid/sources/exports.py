"""Sinks: evidence as STIX, MISP, GeoJSON, KML, Markdown, HTML, RSS and metrics text.

Each is a DataFrame of finished documents, one row each, so that any Spark writer can
store them. Times are parameters; ids come from content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How entity types are named in STIX patterns and in MISP attributes.
STIX_PATH = {
    "ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "domain": "domain-name:value", "url": "url:value",
    "email": "email-addr:value", "md5": "file:hashes.MD5", "sha1": "file:hashes.SHA-1",
    "sha256": "file:hashes.SHA-256", "cve": "vulnerability:name", "btc": "x-cryptocurrency-transaction:value",
}
MISP_TYPE = {
    "ipv4": ("ip-src", "Network activity"), "ipv6": ("ip-src", "Network activity"),
    "domain": ("domain", "Network activity"), "url": ("url", "Network activity"),
    "email": ("email-src", "Payload delivery"), "md5": ("md5", "Payload delivery"),
    "sha1": ("sha1", "Payload delivery"), "sha256": ("sha256", "Payload delivery"),
    "cve": ("vulnerability", "External analysis"), "btc": ("btc", "Financial fraud"),
    "eth": ("text", "Financial fraud"), "asn": ("AS", "Network activity"), "user": ("text", "Social network"),
}
#: Namespace of ids made from names (RFC 4122, URL).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID: SHA-1 over the namespace and the name, with version and variant bits set."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8"))))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    variant = F.element_at(F.split(F.lit("8,9,a,b,8,9,a,b,8,9,a,b,8,9,a,b"), ","), F.conv(part(17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def lookup(table: dict[str, str], c: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


#: Kind of target -> kind of the object that stands for it.
TARGET_OBJECTS = {"domain": "domain-name", "url": "url", "ip": "ipv4-addr", "email": "email-addr", "username": "user-account"}


def observed(evidence: DataFrame, now: str) -> DataFrame:
    """``(investigation_id, seen, seen_refs)`` of ``(investigation_id, target, target_type, plugin_name)``: an object for
    the target and observed data for each result of a source."""
    kind = lookup(TARGET_OBJECTS, F.col("target_type"), "x-target")
    target = F.struct(kind.alias("type"), F.concat(kind, F.lit("--"), uuid5(F.col("target"))).alias("id"), F.col("target").alias("value"))
    who = evidence.groupBy("investigation_id").agg(F.min(F.struct("target", "target_type")).alias("t")).select("investigation_id", "t.*")
    of_target = who.select("investigation_id", target.alias("o")).select("investigation_id", F.lit(0).alias("n"), F.to_json("o").alias("json"), F.col("o.id").alias("id"))
    data = F.struct(
        F.lit("observed-data").alias("type"), F.concat(F.lit("observed-data--"), uuid5(F.concat_ws("-", "target", "plugin_name"))).alias("id"),
        F.lit(now).alias("first_observed"), F.lit(now).alias("last_observed"), F.lit(1).alias("number_observed"), F.col("plugin_name").alias("x_source"),
    )
    of_data = evidence.where("plugin_name <> ''").select("investigation_id", data.alias("o")).select("investigation_id", F.lit(1), F.to_json("o"), "o.id")
    rows = F.array_sort(F.collect_list(F.struct("n", "id", "json")))
    both = of_target.union(of_data).groupBy("investigation_id").agg(rows.alias("r"))
    return both.select("investigation_id", F.transform("r", lambda x: x["json"]).alias("seen"), F.transform("r", lambda x: x["id"]).alias("seen_refs"))


def stix(entities: DataFrame, now: str, evidence: DataFrame | None = None) -> DataFrame:
    """``(investigation_id, bundle)``: an identity, what ``observed`` gives of the evidence if there is any, an
    indicator for each entity, and a report on them."""
    name = lambda kind, n: F.concat(F.lit(kind + "--"), uuid5(n))
    ind = entities.select(
        "investigation_id", "target", name("indicator", F.concat_ws("-", "type", "value")).alias("id"),
        F.concat(
            F.lit("["), lookup(STIX_PATH, F.col("type"), "x-ioc:value"), F.lit(" = '"),
            F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"),
        ).alias("pattern"),
        F.col("value").alias("name"),
    )
    obj = F.struct(
        F.lit("indicator").alias("type"), "id", F.lit(now).alias("created"), F.lit(now).alias("modified"),
        "name", "pattern", F.lit("stix").alias("pattern_type"), F.lit(now).alias("valid_from"),
        F.array(F.lit("malicious-activity")).alias("labels"),
    )
    per = ind.groupBy("investigation_id", "target").agg(F.array_sort(F.collect_list(F.to_json(obj))).alias("objects"), F.array_sort(F.collect_list("id")).alias("refs"))
    none = F.array().cast("array<string>")
    if evidence is None:
        per = per.withColumns({"seen": none, "seen_refs": none})
    else:
        per = per.join(observed(evidence, now), "investigation_id", "left").withColumns({c: F.coalesce(c, none) for c in ("seen", "seen_refs")})
    who = F.to_json(
        F.struct(
            F.lit("identity").alias("type"), name("identity", F.col("target")).alias("id"),
            F.col("target").alias("name"), F.lit("unknown").alias("identity_class"),
            F.lit(now).alias("created"), F.lit(now).alias("modified"),
        )
    )
    report = F.to_json(
        F.struct(
            F.lit("report").alias("type"),
            name("report", F.col("investigation_id").cast("string")).alias("id"),
            F.concat(F.lit("Report on "), "target").alias("name"), F.lit(now).alias("published"),
            F.lit(now).alias("created"), F.lit(now).alias("modified"), F.concat("seen_refs", "refs").alias("object_refs"),
        )
    )
    all_ = F.array_join(F.concat(F.array(who), F.col("seen"), F.col("objects"), F.array(report)), ",")
    return per.select(
        "investigation_id",
        F.concat(F.lit('{"type":"bundle","id":"'), name("bundle", F.col("investigation_id").cast("string")), F.lit('","objects":['), all_, F.lit("]}")).alias("bundle"),
    )


# Tags of every event, and the colours of tags.
MISP_TAGS, PLAIN, ALARM, NOTE = ("type:OSINT", "tlp:amber"), "#0088cc", "#FF0000", "#FFBF00"


def misp(entities: DataFrame, techniques: DataFrame, date: str, results: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """``(investigation_id, event)``: attributes of the target, of each entity and of each source's result,
    in this order; tags of the event, its threat level and each technique.

    ``entities`` has ``investigation_id, target, target_type, type, value, confidence, source, context``;
    ``results`` ``(investigation_id, plugin_name, data)``; ``levels`` ``(investigation_id, level)``. High and
    critical threats are of level 1, all others of 3. An investigation without entities has no event.
    """
    kind = lambda c: lookup({k: v[0] for k, v in MISP_TYPE.items()}, c, "text")
    area = lambda c: lookup({k: v[1] for k, v in MISP_TYPE.items()}, c, "Other")
    own = F.when(F.col("target_type") == "ip", "ipv4").otherwise(F.col("target_type"))
    said = F.concat(F.lit("Extracted by "), F.coalesce("source", F.lit("regex")), F.lit(" - "), F.substring(F.coalesce("context", F.lit("")), 1, 200))

    def attribute(place: int, kind: Column, area: Column, value: Column, sure: Column, comment: Column) -> Column:
        named = {"place": F.lit(place), "type": kind, "category": area, "value": value, "to_ids": sure, "comment": comment, "distribution": F.lit("0")}
        return F.struct(*(c.alias(n) for n, c in named.items())).alias("a")

    text, no = F.lit("text"), F.lit(False)
    rows = entities.select("investigation_id", attribute(0, kind(own), area(own), F.col("target"), no, F.lit("Investigation target"))).distinct()
    sure = F.coalesce(F.col("confidence"), F.lit(50)) >= 80
    rows = rows.unionByName(entities.select("investigation_id", attribute(1, kind(F.col("type")), area(F.col("type")), F.col("value"), sure, said)))
    if results is not None:
        value = F.concat(F.lit("["), "plugin_name", F.lit("] "), F.substring("data", 1, 280))
        found = results.where("plugin_name <> ''").select("investigation_id", attribute(2, text, F.lit("External analysis"), value, no, F.concat(F.lit("Plugin: "), "plugin_name")))
        rows = rows.unionByName(found.join(entities.select("investigation_id").distinct(), "investigation_id", "left_semi"))
    held = rows.groupBy("investigation_id").agg(F.array_sort(F.collect_list("a")).alias("a"), F.max(F.when(F.col("a.place") == 0, F.col("a.value"))).alias("target"))

    tag = lambda name, colour: F.struct(name.alias("name"), colour.alias("colour"))
    galaxy = F.concat(F.lit('misp-galaxy:mitre-attack-pattern="'), "technique_id", F.lit(" - "), "name", F.lit('"'))
    found = techniques.groupBy("investigation_id").agg(F.array_sort(F.collect_set(tag(galaxy, F.lit(PLAIN)))).alias("galaxies"))
    held = held.join(found, "investigation_id", "left")
    held = held.join(levels.select("investigation_id", "level"), "investigation_id", "left") if levels is not None else held.withColumn("level", F.lit(None).cast("string"))
    grave = F.coalesce(F.col("level").isin("HIGH", "CRITICAL"), no)
    level = F.when(F.col("level").isNotNull(), tag(F.concat(F.lit("threat-level:"), F.lower("level")), F.when(grave, ALARM).otherwise(NOTE)))
    tags = F.concat(F.array(*(tag(F.lit(t), F.lit(NOTE if "tlp" in t else PLAIN)) for t in MISP_TAGS)), F.array_compact(F.array(level)), F.coalesce("galaxies", F.array()))
    fields = {
        "info": F.concat(F.lit("Investigation of "), "target"), "date": F.lit(date), "threat_level_id": F.when(grave, "1").otherwise("3"), "analysis": F.lit("2"),
        "distribution": F.lit("0"), "published": no, "Attribute": F.transform("a", lambda x: x.dropFields("place")), "Tag": tags,
    }
    event = F.to_json(F.struct(F.struct(*(c.alias(n) for n, c in fields.items())).alias("Event")))
    return held.select("investigation_id", event.alias("event"))


def navigator(found: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """One ATT&CK layer: found techniques score 100, the rest of the catalogue 0."""
    hit = found.select("technique_id").distinct()
    rows = hit.withColumn("score", F.lit(100)).unionByName(
        catalogue.select("technique_id").distinct().join(hit, "technique_id", "left_anti").withColumn("score", F.lit(0))
    )
    each = F.struct(F.col("technique_id").alias("techniqueID"), "score", (F.col("score") > 0).alias("enabled"))
    return rows.agg(
        F.to_json(F.struct(F.lit(name).alias("name"), F.lit("enterprise-attack").alias("domain"), F.array_sort(F.collect_list(each)).alias("techniques"))).alias("layer")
    )


def geojson(points: DataFrame) -> DataFrame:
    """``(investigation_id, geojson)`` of ``(investigation_id, name, lat, lon)``; points without a place are left out."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("name").alias("properties"),
    )
    per = points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("investigation_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.to_json(feature))), ",").alias("f")
    )
    return per.select("investigation_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("geojson"))


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def kml(points: DataFrame) -> DataFrame:
    mark = F.concat(
        F.lit("<Placemark><name>"), escape(F.col("name")), F.lit("</name><Point><coordinates>"),
        F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"),
        F.lit(",0</coordinates></Point></Placemark>"),
    )
    per = points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("investigation_id").agg(F.array_join(F.array_sort(F.collect_list(mark)), "").alias("m"))
    return per.select(
        "investigation_id",
        F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), "m", F.lit("</Document></kml>")).alias("kml"),
    )


def markdown(evidence: DataFrame) -> DataFrame:
    """``(investigation_id, report)`` of ``(investigation_id, target, section, field, value)``; values are cut at 200."""
    line = F.concat(F.lit("- **"), "field", F.lit("**: "), F.substr("value", F.lit(1), F.lit(200)))
    parts = evidence.groupBy("investigation_id", "target", "section").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("## "), "section", F.lit("\n"), "body")
    return parts.groupBy("investigation_id", "target").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n\n").alias("t")).select(
        "investigation_id", F.concat(F.lit("# Report: "), "target", F.lit("\n\n"), "t").alias("report"),
    )


def html(report: Column) -> Column:
    c = escape(report)
    for pattern, to in (
        (r"(?m)^### (.*)$", "<h3>$1</h3>"), (r"(?m)^## (.*)$", "<h2>$1</h2>"),
        (r"(?m)^# (.*)$", "<h1>$1</h1>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
        (r"(?m)^- (.*)$", "<li>$1</li>"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.concat(F.lit("<html><body>"), c, F.lit("</body></html>"))


def rss(investigations: DataFrame, title: str, most: int = 20) -> DataFrame:
    """One feed of the newest ``most`` rows of ``(id, target, status, summary, created_at)``."""
    top = investigations.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    item = F.concat(
        F.lit("<item><title>"), escape(F.concat(F.lit("["), F.upper("status"), F.lit("] "), "target")),
        F.lit("</title><guid>"), F.col("id").cast("string"), F.lit("</guid><pubDate>"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate><description>"),
        escape(F.substr("summary", F.lit(1), F.lit(300))), F.lit("</description></item>"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("a"), (-F.col("id")).alias("b"), item.alias("item"))))
    return top.agg(
        F.concat(
            F.lit(f'<?xml version="1.0"?><rss version="2.0"><channel><title>{title}</title>'),
            F.array_join(F.transform(ordered, lambda x: x["item"]), ""), F.lit("</channel></rss>"),
        ).alias("feed")
    )


def metrics(counts: DataFrame) -> DataFrame:
    """``(line)``: Prometheus text of ``(metric, label, label_value, value)``."""
    labelled = F.format_string('%s{%s="%s"} %d', "metric", "label", "label_value", "value")
    return counts.select(F.when(F.col("label").isNull(), F.format_string("%s %d", "metric", "value")).otherwise(labelled).alias("line"))


def alerts(changes: DataFrame, most: int = 4000) -> DataFrame:
    """``(monitor_id, payload)``: one webhook body for each monitor with changes."""
    per = changes.groupBy("monitor_id").agg(F.array_sort(F.collect_list("change")).alias("changes"))
    body = F.to_json(
        F.struct(
            F.lit("monitor.changed").alias("event"), "changes", F.size("changes").alias("change_count"),
            F.substr(F.array_join("changes", "\n"), F.lit(1), F.lit(most)).alias("message"),
        )
    )
    return per.select("monitor_id", body.alias("payload"))


def last_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
