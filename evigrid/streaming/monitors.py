"""Stateful operators over evidence streams.

A monitor keeps the last fingerprint it saw and how often it changed: the first one is
taken without an alert, each different one raises one. State is a few values a key, so
it does not grow with the stream. Late rows within a micro-batch are put in time order;
rows older than the state's last time are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigrid.plans.lineage import scratch

ALERTS = "monitor_id long, at timestamp_ntz, seq long, old string, new string, change_count long, message string"
STATE = "last string, at timestamp_ntz, seq long, n long"
#: Schedule -> interval of a monitor.
SCHEDULES = {"hourly": "1 HOUR", "daily": "1 DAY", "weekly": "7 DAYS"}


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, at, seq, n = state.get if state.exists else (None, None, -1, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    out = []
    for r in rows.itertuples():
        if at is not None and (r.at, r.seq) <= (at, seq):
            continue
        if last is not None and r.fingerprint != last:
            n += 1
            message = getattr(r, "summary", None) or "content changed"
            out.append((key[0], r.at, r.seq, last, r.fingerprint, n, message))
        last, at, seq = r.fingerprint, r.at, r.seq
    state.update((last, at, int(seq), int(n)))
    yield pd.DataFrame(out, columns=["monitor_id", "at", "seq", "old", "new", "change_count", "message"])


def changes(observed: DataFrame) -> DataFrame:
    """Alerts from ``(monitor_id, at, seq, fingerprint, summary)``, batch by batch. A monitor's rows of one
    micro-batch are sorted in memory; ``watch`` takes batches of any size."""
    return observed.groupBy("monitor_id").applyInPandasWithState(_watch, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, path: str, checkpoint: str):
    """As ``changes``, for micro-batches of any size: a batch is put in order by sorting on disk, not in
    memory, and each monitor's last state is a row of a table.

    Batch ``n`` reads ``state/n-1``, writes ``state/n`` and its alerts under ``alerts/n``; run again
    after a failure it writes the same once more.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        order = Window.partitionBy("monitor_id").orderBy("at", "seq")
        rows = batch.select("monitor_id", "at", "seq", "fingerprint", "summary")
        if n:
            past = spark.read.parquet(f"{path}/state/{n - 1}")
        else:
            past = spark.createDataFrame([], "monitor_id long, p_at timestamp_ntz, p_seq long, p_last string, p_n long")
        new = rows.join(past, "monitor_id", "left").where("p_at IS NULL OR at > p_at OR (at = p_at AND seq > p_seq)")
        old = F.coalesce(F.lag("fingerprint").over(order), F.col("p_last"))
        seen = new.withColumn("old", old).withColumn("changed", F.coalesce(F.col("old") != F.col("fingerprint"), F.lit(False)))
        counted = seen.withColumn("n", F.coalesce("p_n", F.lit(0)) + F.sum(F.col("changed").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        message = F.coalesce("summary", F.lit("content changed")).alias("message")
        alerts = counted.where("changed").select("monitor_id", "at", "seq", "old", F.col("fingerprint").alias("new"), F.col("n").alias("change_count"), message)
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/{n}")
        last = counted.groupBy("monitor_id").agg(F.max(F.struct("at", "seq", "fingerprint", "n")).alias("s")).select(
            "monitor_id", F.col("s.at").alias("p_at"), F.col("s.seq").alias("p_seq"),
            F.col("s.fingerprint").alias("p_last"), F.col("s.n").alias("p_n"),
        )
        last.union(past.join(last, "monitor_id", "left_anti")).write.mode("overwrite").parquet(f"{path}/state/{n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(stream: DataFrame, name: str = "monitors") -> DataFrame:
    """Alerts of ``watch`` over all that is there now, from a table in the shared folder."""
    base = scratch(stream.sparkSession, name)
    q = watch(stream, base, f"{base}/checkpoint")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(ALERTS).parquet(f"{base}/alerts/*")


def next_check(at: Column, schedule: Column) -> Column:
    out = at + F.expr("INTERVAL 1 DAY")
    for k, v in SCHEDULES.items():
        out = F.when(schedule == k, at + F.expr(f"INTERVAL {v}")).otherwise(out)
    return out


def due(monitors: DataFrame, now: Column) -> DataFrame:
    return monitors.where(F.col("active") & (F.col("next_check") <= now))


def delivered_once(evidence: DataFrame, at: str = "at", delay: str = "1 hour", keys: tuple[str, ...] = ("execution_id", "plugin_id")) -> DataFrame:
    """Drops repeated deliveries that come within ``delay`` of the first."""
    return evidence.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def not_in_future(evidence: DataFrame, now: Column, at: str = "at") -> DataFrame:
    return evidence.where(F.col(at) <= now + F.expr("INTERVAL 5 MINUTES"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def into_store(stream: DataFrame, path: str, checkpoint: str, at: str | None = None):
    """Idempotent sink: each micro-batch adds only keys that the store does not have, so a batch
    that is run again after a failure changes nothing. With ``at``, the time of delivery that is
    part of what is delivered, the store is parted by day and only the batch's days are read."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keys = ["execution_id", "plugin_id"]
        new = batch.dropDuplicates(keys)
        if at:
            new = new.withColumn("day", F.to_date(at))
        try:
            stored = spark.read.schema(new.schema).parquet(path)
            if at:  # the days of a batch are few
                stored = stored.where(F.col("day").isin([r[0] for r in new.select("day").distinct().collect()]))
            new = new.join(stored.select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        (new.write.mode("append").partitionBy("day") if at else new.write.mode("append")).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
