"""Sinks over the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import scoring
from evigrid.queries.registry import query
from evigrid.queries.scores import _P, _T, _payloads
from evigrid.session import table
from evigrid.sources import exports, images

NOW = "2024-02-01T00:00:00Z"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS investigation_id", "concat('nation-', c_nationkey) AS target",
        "IF(c_custkey % 2 = 0, 'email', 'ipv4') AS type",
        "IF(c_custkey % 2 = 0, concat('u', c_custkey, '@x.org'), concat('10.0.0.', c_custkey)) AS value",
        "CAST(c_custkey % 100 AS INT) AS confidence",
    )


@query(
    "SELECT c_nationkey AS investigation_id, 'nation-' || c_nationkey AS name, count(*) + 2 AS n_objects, count(*) AS n_refs, min(CASE"
    " WHEN c_custkey % 2 = 0 THEN '[email-addr:value = ''u' || c_custkey || '@x.org'']' ELSE '[ipv4-addr:value = ''10.0.0.' || c_custkey || ''']' END)"
    " AS least_pattern FROM customer GROUP BY c_nationkey"
)
def stix_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: bundles, read back from their JSON."""
    b = exports.stix(_entities(spark, sf_dir), NOW)
    kind = "struct<type:string,objects:array<struct<type:string,id:string,name:string,pattern:string,object_refs:array<string>>>>"
    o = F.from_json("bundle", kind)["objects"]
    return b.select(
        "investigation_id", o[0]["name"].alias("name"), F.size(o).cast("long").alias("n_objects"),
        F.size(F.element_at(o, -1)["object_refs"]).cast("long").alias("n_refs"),
        F.array_min(F.transform(F.filter(o, lambda x: x["pattern"].isNotNull()), lambda x: x["pattern"])).alias("least_pattern"),
    )


@query("""SELECT c_nationkey AS investigation_id, count(*) + 2 + 1 + count(DISTINCT c_mktsegment) AS n_objects, count(*) + 1 + count(DISTINCT c_mktsegment) AS n_refs,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sources, CASE WHEN c_nationkey % 2 = 0 THEN 'domain-name' ELSE 'x-target' END AS target_kind FROM customer GROUP BY c_nationkey""")
def stix_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: bundles with the target's object and observed data of each source, read back from their JSON."""
    c = table(spark, sf_dir, "customer")
    seen = c.selectExpr("c_nationkey AS investigation_id", "concat('nation-', c_nationkey) AS target", "IF(c_nationkey % 2 = 0, 'domain', 'company') AS target_type", "c_mktsegment AS plugin_name").distinct()
    kind = "struct<objects:array<struct<type:string,x_source:string,object_refs:array<string>>>>"
    o = F.from_json("bundle", kind)["objects"]
    sources = F.array_sort(F.transform(F.filter(o, lambda x: x["type"] == "observed-data"), lambda x: x["x_source"]))
    return exports.stix(_entities(spark, sf_dir), NOW, seen).select(
        "investigation_id", F.size(o).cast("long").alias("n_objects"), F.size(F.element_at(o, -1)["object_refs"]).cast("long").alias("n_refs"),
        F.array_join(sources, ",").alias("sources"), o[1]["type"].alias("target_kind"),
    )


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS i, 0 AS p, 'text' AS t, 'nation-' || c_nationkey AS v, false AS s FROM customer
  UNION ALL SELECT c_nationkey, 1, CASE WHEN c_custkey % 2 = 0 THEN 'email-src' ELSE 'ip-src' END, CASE WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey || '@x.org' ELSE '10.0.0.' || c_custkey END, c_custkey % 100 >= 80 FROM customer
  UNION ALL SELECT s_nationkey, 2, 'text', '[supplier] ' || substr(s_name || repeat('.', 300), 1, 280), false FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)),
l AS (SELECT s_nationkey AS i, CASE WHEN count(*) > 5 THEN 'CRITICAL' WHEN count(*) > 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM supplier GROUP BY s_nationkey)
SELECT i AS investigation_id, string_agg(t || '=' || v || CASE WHEN s THEN '!' ELSE '' END, chr(10) ORDER BY p, t, v) AS attributes, CASE WHEN any_value(level) = 'CRITICAL' THEN '1' ELSE '3' END AS threat_level,
  'type:OSINT,tlp:amber' || coalesce(',threat-level:' || lower(any_value(level)), '') AS tags FROM a LEFT JOIN l USING (i) GROUP BY i""")
def misp_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: events with target, entities, results of sources and threat level, read back from their JSON."""
    given = _entities(spark, sf_dir).selectExpr("*", "'company' AS target_type", "'regex' AS source", "CAST(NULL AS STRING) AS context")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "investigation_id")
    results = s.selectExpr("investigation_id", "'supplier' AS plugin_name", "concat(s_name, repeat('.', 300)) AS data")
    n = F.count("*")
    levels = s.groupBy("investigation_id").agg(F.when(n > 5, "CRITICAL").when(n > 1, "MEDIUM").otherwise("LOW").alias("level"))
    none = scoring.techniques(_payloads(spark, sf_dir)).where("false").withColumn("investigation_id", F.col("investigation_id").cast("int"))
    m = exports.misp(given, none, "2024-02-01", results, levels)
    e = F.from_json("event", "struct<Event:struct<threat_level_id:string,Attribute:array<struct<type:string,value:string,to_ids:boolean>>,Tag:array<struct<name:string>>>>")["Event"]
    line = F.transform(e["Attribute"], lambda x: F.concat(x["type"], F.lit("="), x["value"], F.when(x["to_ids"], "!").otherwise("")))
    return m.select("investigation_id", F.array_join(line, "\n").alias("attributes"), e["threat_level_id"].alias("threat_level"), F.array_join(e["Tag"]["name"], ",").alias("tags"))


@query(_P + _T + " SELECT user_id AS investigation_id, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM t GROUP BY user_id")
def misp_galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the techniques that tag an event, read back from it."""
    p = _payloads(spark, sf_dir)
    named = p.selectExpr("investigation_id", "concat('user-', investigation_id) AS target", "'user' AS target_type", "'user' AS type", "CAST(investigation_id AS STRING) AS value", "1 AS confidence", "'log' AS source", "'' AS context")
    e = F.from_json("event", "struct<Event:struct<Tag:array<struct<name:string>>>>")["Event"]["Tag"]["name"]
    found = F.filter(F.transform(e, lambda t: F.regexp_extract(t, '"(T[0-9.]+) - ', 1)), lambda t: t != "")
    m = exports.misp(named, scoring.techniques(p), "2024-02-01").select("investigation_id", F.array_join(F.array_sort(found), ",").alias("techniques"))
    return m.where("techniques <> ''")


@query(_P + _T + f" SELECT {len(scoring.TECHNIQUES)}::BIGINT AS n, (count(DISTINCT technique_id) * 100)::BIGINT AS score FROM t")
def navigator_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    catalogue = spark.createDataFrame(scoring.TECHNIQUES, "technique_id string, name string, tactic string")
    layer = exports.navigator(scoring.techniques(_payloads(spark, sf_dir)), catalogue, "layer")
    t = F.from_json("layer", "struct<techniques:array<struct<techniqueID:string,score:bigint>>>")["techniques"]
    return layer.select(F.size(t).cast("long").alias("n"), F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x["score"]).alias("score"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS investigation_id", "s_name AS name",
        "IF(s_suppkey % 3 = 0, NULL, CAST(s_suppkey % 90 AS DOUBLE)) AS lat",
        "CAST(s_suppkey % 180 AS DOUBLE) AS lon",
    )


@query(
    "SELECT s_nationkey AS investigation_id, count(*) AS n, sum(s_suppkey % 90)::DOUBLE AS lat, count(*) AS n_kml FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY s_nationkey"
)
def geo_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: GeoJSON and KML of the same points."""
    p = _points(spark, sf_dir)
    f = F.from_json("geojson", "struct<features:array<struct<geometry:struct<coordinates:array<double>>>>>")["features"]
    g = exports.geojson(p).select(
        "investigation_id", F.size(f).cast("long").alias("n"),
        F.aggregate(f, F.lit(0.0), lambda a, x: a + x["geometry"]["coordinates"][1]).alias("lat"),
    )
    k = exports.kml(p).select("investigation_id", F.size(F.regexp_extract_all("kml", F.lit("<Placemark>"), 0)).cast("long").alias("n_kml"))
    return g.join(k, "investigation_id")


@query("""WITH l AS (SELECT o_custkey AS c, o_orderstatus AS s, '- **' || o_orderkey || '**: ' || o_orderpriority AS x FROM orders), p AS (SELECT c,
  '## ' || s || chr(10) || string_agg(x, chr(10) ORDER BY x) AS t FROM l GROUP BY c, s)
SELECT c AS investigation_id, '# Report: c' || c || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY t) AS report FROM p GROUP BY c""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K13."""
    o = table(spark, sf_dir, "orders")
    return exports.markdown(
        o.selectExpr(
            "o_custkey AS investigation_id", "concat('c', o_custkey) AS target", "o_orderstatus AS section",
            "CAST(o_orderkey AS STRING) AS field", "o_orderpriority AS value",
        )
    )


@query("SELECT o_custkey AS investigation_id, count(DISTINCT o_orderstatus) AS n_h2, count(*) AS n_li FROM orders GROUP BY o_custkey")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    h = markdown_report(spark, sf_dir).select("investigation_id", exports.html(F.col("report")).alias("h"))
    return h.select(
        "investigation_id", F.size(F.regexp_extract_all("h", F.lit("<h2>"), 0)).cast("long").alias("n_h2"),
        F.size(F.regexp_extract_all("h", F.lit("<li>"), 0)).cast("long").alias("n_li"),
    )


@query(
    "SELECT '<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>Orders</title>' || string_agg('<item><title>[' || o_orderstatus || '] c' || o_custkey || '</title><guid>' || o_orderkey || '</guid><pubDate>' || strftime(o_orderdate,"
    " '%Y-%m-%dT%H:%M:%SZ') || '</pubDate><description>' || o_orderpriority || '</description></item>', '' ORDER BY o_orderdate DESC,"
    " o_orderkey DESC) || '</channel></rss>' AS feed FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)"
)
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, O4."""
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "concat('c', o_custkey) AS target", "o_orderstatus AS status",
        "o_orderpriority AS summary", "o_orderdate AS created_at",
    )
    return exports.rss(o, "Orders")


@query(
    "SELECT 'investigations_total ' || count(*) AS line FROM orders UNION ALL SELECT 'investigations_by_status{status=\"' || o_orderstatus || '\"} ' || count(*)"
    " FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'plugin_executions{plugin=\"' || event_type || '\"} ' || count(*) FROM events GROUP BY event_type"
)
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9, A18."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    total = o.agg(
        F.lit("investigations_total").alias("metric"), F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("string").alias("label_value"), F.count("*").alias("value"),
    )
    by = lambda df, m, label, c: df.groupBy(c).agg(F.count("*").alias("value")).select(
        F.lit(m).alias("metric"), F.lit(label).alias("label"), F.col(c).alias("label_value"), "value",
    )
    return exports.metrics(
        total.unionByName(by(o, "investigations_by_status", "status", "o_orderstatus")).unionByName(by(e, "plugin_executions", "plugin", "event_type"))
    )


@query("SELECT o_custkey AS monitor_id, count(*) AS change_count FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def webhook_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    c = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS monitor_id", "concat('order ', o_orderkey) AS change")
    return exports.alerts(c).select("monitor_id", F.get_json_object("payload", "$.change_count").cast("long").alias("change_count"))


def _photographs(df: DataFrame, n: str, little: Column) -> DataFrame:
    """JPEG bytes with a camera and a place for each row, in either byte order."""

    def num(value: Column | int, size: int, turn: bool = True) -> Column:
        big = F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * size, "0")
        return F.when(little & F.lit(turn), F.array_join(F.reverse(F.regexp_extract_all(big, F.lit(".."), 0)), "")).otherwise(big)

    def entry(tag: int, kind: int, count: int, value: Column) -> Column:
        return F.concat(num(tag, 2), num(kind, 2), num(count, 4), value)

    k = F.col(n)
    text = lambda c, size: F.rpad(F.hex(F.encode(c, "UTF-8")), 2 * size, "0")
    angle = lambda deg, minute, sec: F.concat(num(deg, 4), num(1, 4), num(minute, 4), num(1, 4), num(sec, 4), num(100, 4))
    tiff = F.concat(
        F.when(little, "4949").otherwise("4D4D"), num(42, 2), num(8, 4),
        num(2, 2), entry(0x0110, 2, 20, num(38, 4)), entry(0x8825, 4, 1, num(58, 4)), num(0, 4), text(F.concat(F.lit("Cam "), k), 20),
        num(4, 2), entry(1, 2, 2, text(F.when(k % 2 == 0, "N").otherwise("S"), 4)), entry(2, 5, 3, num(112, 4)),
        entry(3, 2, 2, text(F.when(k % 3 == 0, "E").otherwise("W"), 4)), entry(4, 5, 3, num(136, 4)), num(0, 4),
        angle(k % 90, k % 60, k * 7 % 6000), angle(k * 3 % 180, k * 5 % 60, k * 11 % 6000),
    )
    frame = F.concat(F.lit("FFC0001108"), num(k % 4000 + 1, 2, False), num(k % 3000 + 1, 2, False), F.lit("03" + "00" * 9))
    return df.select(n, F.unhex(F.concat(F.lit("FFD8FFE100A8457869660000"), tiff, frame, F.lit("FFD9"))).alias("content"))


@query("""SELECT c_custkey, 'jpeg' AS format, (c_custkey % 3000 + 1)::INT AS width, (c_custkey % 4000 + 1)::INT AS height, 'Cam ' || c_custkey AS model,
  round(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 90 + c_custkey % 60 / 60 + c_custkey * 7 % 6000 / 360000), 6) AS latitude,
  round(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END * (c_custkey * 3 % 180 + c_custkey * 5 % 60 / 60 + c_custkey * 11 % 6000 / 360000), 6) AS longitude FROM customer""")
def image_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera, size and place read from images that are packed from customers, in both byte orders."""
    made = _photographs(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", F.col("c_custkey") % 5 < 2)
    found = images.metadata(made, "c_custkey")
    return found.select("c_custkey", "format", "width", "height", "model", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))
