"""Analytical reads over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.operators import reads, trigrams
from evigrid.queries.registry import query
from evigrid.session import table
from evigrid.sources import files
from evigrid.sources.canonical import EV, evidence


@query("""WITH b AS (SELECT * FROM (SELECT 0 AS o, 'customers' AS branch, c_custkey AS id, substr(c_name, 1, 80) AS title FROM customer WHERE c_name ILIKE '%10%'
  ORDER BY id LIMIT 20) UNION ALL SELECT * FROM (SELECT 1, 'parts', p_partkey, substr(p_name, 1, 80) FROM part WHERE p_name ILIKE '%10%' OR p_type ILIKE '%10%'
  ORDER BY p_partkey LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 2, 'suppliers', s_suppkey, substr(s_name, 1, 80) FROM supplier WHERE s_name ILIKE '%10%' ORDER BY s_suppkey LIMIT 20)) SELECT branch, id,
  title FROM b ORDER BY o, id LIMIT 30""")
def search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches, a limit in each and one over all."""
    c, p, s = (table(spark, sf_dir, n) for n in ("customer", "part", "supplier"))
    return reads.search(
        [("customers", c, "c_custkey", ["c_name"]), ("parts", p, "p_partkey", ["p_name", "p_type"]), ("suppliers", s, "s_suppkey", ["s_name"])],
        "10", 20, 30,
    )


@query(
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"
)
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2, F1: one page in a total order."""
    o = reads.filtered(table(spark, sf_dir, "orders"), {"o_orderpriority": "urgent"}, o_orderstatus="F", o_custkey=None)
    return reads.page(o, "o_totalprice", True, "o_orderkey", 50, 25).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent, sum(count(*)) OVER ()::BIGINT AS total FROM orders GROUP BY o_orderstatus"
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
    )
    return per.crossJoin(per.agg(F.sum("n").alias("total")))  # one row of three


@query("SELECT c_custkey, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, J7, J9, J10."""
    return reads.child_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "n_children")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' - INTERVAL 90 DAY)"
)
def retention_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, F8, ST9, M2: children of parents within the retention."""
    cut = F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00' - INTERVAL 90 DAYS")
    gone = reads.expired(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), cut, "l_orderkey", "o_orderdate")
    return reads.retained(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), gone, "l_orderkey")


@query(f"""WITH {EV}, t AS (SELECT user_id AS investigation_id, 0 AS last, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS moment, 'start' AS kind, '' AS detail FROM ev
  GROUP BY user_id UNION ALL SELECT user_id, 0, strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'evidence', event_type || ':' || event_id FROM ev UNION ALL SELECT user_id, 1,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S'), 'complete', '' FROM ev GROUP BY user_id)
SELECT investigation_id, moment AS "at", kind, detail, row_number() OVER (PARTITION BY investigation_id ORDER BY last, rpad(moment, 32, ' '), kind, detail)::INT AS place FROM t""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR8, O7: start, evidence, and the completion last."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ev = evidence(spark, sf_dir).withColumnRenamed("user_id", "investigation_id")
    first = ev.groupBy("investigation_id").agg(F.min("ts").alias("ts"))
    mark = lambda k: first.select("investigation_id", iso("ts").alias("at"), F.lit(k).alias("kind"), F.lit("").alias("detail"))
    each = ev.select("investigation_id", iso("ts").alias("at"), F.lit("evidence").alias("kind"), F.concat_ws(":", "event_type", "event_id").alias("detail"))
    return reads.timeline([mark("start"), each], mark("complete"))


@query(
    f"WITH {EV}, a AS (SELECT k, max(value) AS v FROM ev WHERE user_id % 2 = 0 GROUP BY k), b AS (SELECT k, max(value) AS v FROM ev WHERE user_id % 2 = 1 GROUP BY k)"
    f" SELECT k, CASE WHEN b.v IS NULL THEN 'only_in_1' WHEN a.v IS NULL THEN 'only_in_2' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state FROM a FULL"
    f" JOIN b USING (k)"
)
def investigation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What even users found against what odd users did."""
    ev = evidence(spark, sf_dir)
    side = lambda n: ev.where(F.col("user_id") % 2 == n).groupBy("k").agg(F.max("value").alias("v"))
    return reads.compared(side(0), side(1), "k", "v")


@query(
    "SELECT lang, source, n, place FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source)::INT AS place"
    " FROM documents GROUP BY lang, source) WHERE place <= 5"
)
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent sources of each language."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return reads.top_per_group(n, ["lang"], [F.desc("n"), F.col("source")], 5)


@query(
    "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O,"
    " max(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey"
)
def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables to columns, with the variables named beforehand."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))


@query(
    "SELECT o_custkey AS key, arg_max(o_orderkey, (epoch_us(o_orderdate) // 1000000) * 100000000 + o_orderkey) AS result FROM orders"
    " WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey"
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has not expired, the newest of each key."""
    c = table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_orderkey AS result", "o_orderdate AS expires_at")
    return files.fresh(c, __import__("datetime").datetime(1997, 1, 1)).select("key", "result")


@query(
    "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') > 0 AS active FROM customer"
    " WHERE c_nationkey = 3 OR c_nationkey IS NULL"
)
def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an owner, and whether they have due children."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3 OR c_nationkey IS NULL")
    due = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    return c.join(due, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("active", F.lit(False)).alias("active"))


@query(f"""WITH RECURSIVE {EV}, q AS (SELECT user_id AS client, event_id AS request_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id
  ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM ev),
w AS (SELECT client, n, request_id, true AS ok, t AS a, NULL::BIGINT AS b FROM q WHERE n = 1
UNION ALL SELECT q.client, q.n, q.request_id, w.b IS NULL OR w.b <= q.t - 3600, CASE WHEN w.b IS NULL OR w.b <= q.t - 3600 THEN q.t ELSE w.a END, CASE WHEN w.b IS NULL
  OR w.b <= q.t - 3600 THEN w.a ELSE w.b END FROM w JOIN q ON q.client = w.client AND q.n = w.n + 1)
SELECT client, request_id FROM w WHERE ok""")
def allowed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, W1: a limiter of two requests an hour for each user (refused ones do not count; tested
    against a walk through each user's requests)."""
    return reads.allowed_requests(
        evidence(spark, sf_dir).select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("ts").alias("at")),
        2, 3600,
    )


@query("""WITH t AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN substr(text, 3, 2) ELSE upper(substr(text, 10, 14)) END AS term FROM benchmark)
SELECT item_id AS term_id, doc_id AS id FROM t JOIN documents d ON contains(lower(d.text), lower(term)) WHERE term <> ''""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of benchmark items in all documents, whatever the case, by trigram postings."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    term = F.when(F.col("item_id").cast("long") % 10 == 0, F.substring("text", 3, 2)).otherwise(trigrams.upper_each(F.substring("text", 10, 14)))
    terms = items.select(F.col("item_id").alias("term_id"), term.alias("term"))
    return trigrams.search(docs, "doc_id", "text", trigrams.index(docs, "doc_id", "text"), terms)
