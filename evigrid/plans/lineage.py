"""Cutting lineage with tables that every executor can read again.

Iterative operators and results that are read more than once are written as
Parquet below the shared checkpoint folder, in one folder for each application.
``clear`` removes that folder, once nothing made from its tables is read any more.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir``, or the one that was given to the
    context. Only a local master may have neither: then a temporary one of our own will do, which on
    a cluster every executor would have for itself."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evigrid-")
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evigrid-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once and read back, so that later plans start from files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application wrote to cut lineage."""
    jvm, path = spark._jvm, _folder(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; sized by whoever knows the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task gets of a table that is dealt by its size, about.
ROWS = 1 << 20


def tasks(df: DataFrame) -> int:
    """The number of tasks that a table's rows want, at least that of shuffle partitions; for tables whose
    count is read from their files. Dealt over a given number, small-looking parts are not coalesced."""
    return max(partitions(df.sparkSession), math.ceil(df.count() / ROWS))
