"""Files and databases as evidence sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.session import ship

PAYLOAD = "investigation_id long, plugin_name string, success boolean, collected_at timestamp_ntz, data string"
GOLDEN = "plugin_id string, fixture_name string, input string, legacy_result struct<success:boolean,data:string,error:string>, expected_canonical string, schema_version int"


def payloads(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Captured plugin results, one a line or row; the payload as text and as VARIANT."""
    ship(spark)
    df = spark.read.schema(PAYLOAD).format(kind).load(path)
    return df.withColumnRenamed("data", "raw").withColumn("data", F.try_parse_json("raw"))


def combined(df: DataFrame) -> DataFrame:
    """One row an investigation: ``data`` maps each successful plugin to its latest payload."""
    last = df.where("success").groupBy("investigation_id", "plugin_name").agg(F.max_by("raw", "collected_at").alias("raw"))
    pair = F.concat(F.to_json(F.array("plugin_name")), F.lit(":"), F.col("raw"))
    text = F.array_join(F.array_sort(F.collect_list(F.regexp_replace(pair, r'^\["(.*?)"\]:', '"$1":'))), ",")
    return last.groupBy("investigation_id").agg(F.try_parse_json(F.concat(F.lit("{"), text, F.lit("}"))).alias("data"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden fixtures: multi-line JSON, failing fast on a file that is not one or lacks a field."""
    df = spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    need = ("plugin_id", "fixture_name", "input", "legacy_result", "expected_canonical", "schema_version")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in need)))
    checked = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))).otherwise(F.col("plugin_id"))
    return df.withColumn("plugin_id", checked)


def snapshots(pages: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """``(page_id, sha256, size_bytes, html_base64)`` of the first ``most_bytes`` of each page."""
    body = F.substring(F.encode("html", "UTF-8"), 1, most_bytes)
    return pages.select("page_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"), F.base64(body).alias("html_base64"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Digests and kind of image and PDF files, from their first bytes."""
    df = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("25504446"), "pdf").otherwise("other")
    return df.select("path", "length", kind.alias("kind"), F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def pdf_fields(files: DataFrame) -> DataFrame:
    """Title, author, producer and creator of PDF bodies."""
    body = F.decode("content", "ISO-8859-1")
    field = lambda n: F.regexp_extract(body, rf"/{n}\s*\(([^)]*)\)", 1)
    return files.select("path", *(field(n).alias(n.lower()) for n in ("Title", "Author", "Producer", "Creator")))


def jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table read in parallel ranges of a key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def fresh(cache: DataFrame, now, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Cached rows that have not expired, the newest of each key."""
    live = cache.where(F.col("expires_at") >= F.lit(now))
    rest = [c for c in cache.columns if c not in keys]
    return live.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("expires_at", *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
