"""Operators over evidence streams that keep state by monitor, plugin or client.

Each takes a micro-batch and the state that the batch before left, and gives what it found and the
new state: a table with a row for each key, read and written by ``over_batches``. All is joins,
windows and folds of columns, so that a key costs no call of Python and no round trip to a store.
Rows that are older than what their key has seen are late and left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.plans.lineage import scratch

#: Sets of a monitor's findings, whether what goes is told as well as what comes, and whether an
#: empty set on either side is no change but a run without an answer.
SETS = {
    "subdomains": (True, False), "vulnerabilities": (True, False), "ports": (True, False), "threats": (False, False),
    "profiles": (True, False), "registrations": (False, False), "addresses": (True, True),
}
#: New certificates up to this many are no change.
CERTIFICATES = 5
RUN = "monitor_id long, at timestamp_ntz, seq long, breach boolean, credentials boolean, tor boolean, ip string, certificates long, sets map<string, array<string>>"


def _later(batch: DataFrame, past: DataFrame | None, key: str, order: tuple[str, ...]) -> DataFrame:
    """The rows of a batch that come after what their key has seen."""
    if past is None:
        return batch
    seen = past.select(key, F.struct(*order).alias("_seen"))
    return batch.join(seen, key, "left").where(F.col("_seen").isNull() | (F.struct(*order) > F.col("_seen"))).drop("_seen")


def _changes(sets: Column) -> list[Column]:
    """``(change, items, n)`` of a run and the one before, ``o``; null where nothing changed."""
    told = lambda word, items, n: F.struct(F.lit(word).alias("change"), items.cast("string").alias("items"), n.cast("long").alias("n"))
    none, one = F.array().cast("array<string>"), F.lit(1)
    out = []
    for kind, (gone_too, both) in SETS.items():
        was, now = (F.coalesce(F.element_at(x, kind), none) for x in (F.col("o.sets"), sets))
        for word, a, b in (("added", now, was), ("removed", was, now))[: 1 + gone_too]:
            items = F.array_sort(F.array_except(a, b))
            asked = (F.size(items) > 0) & (F.size(was) > 0) & (F.size(now) > 0) if both else F.size(items) > 0
            out.append(F.when(asked, told(f"{kind} {word}", F.array_join(items, ","), F.size(items))))
    fact = lambda c: F.coalesce(c, F.lit(False))
    for c, word in (("breach", "breach"), ("credentials", "credentials leaked"), ("tor", "tor exit node")):
        out.append(F.when(fact(c) & ~fact(f"o.{c}"), told(word, F.lit(None), one)))
    out.append(F.when(fact("o.tor") & ~fact("tor"), told("no tor exit node", F.lit(None), one)))
    out.append(F.when((F.col("o.ip") != "") & (F.col("ip") != "") & (F.col("o.ip") != F.col("ip")), told("ip", F.concat("o.ip", F.lit(","), "ip"), one)))
    more = F.col("certificates") - F.col("o.certificates")
    return [*out, F.when(more > CERTIFICATES, told("certificates", F.lit(None), more))]


def monitor_changes(runs: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(monitor_id, at, seq, change, items, n)`` from a batch of runs (``RUN``): what came and went of
    each set, transitions of facts, a new address, and more than five new certificates. The first run
    of a monitor is taken without a change. The state is each monitor's last run."""
    fields = [c for c in runs.columns if c != "monitor_id"]
    rows = _later(runs.dropDuplicates(["monitor_id", "at", "seq"]), past, "monitor_id", ("at", "seq")).withColumn("_new", F.lit(True))
    if past is not None:
        rows = rows.unionByName(past.withColumn("_new", F.lit(False)))
    order = Window.partitionBy("monitor_id").orderBy("at", "seq")
    pairs = rows.withColumn("o", F.lag(F.struct(*fields)).over(order)).where("_new AND o IS NOT NULL")
    found = pairs.select("monitor_id", "at", "seq", F.inline(F.array_compact(F.array(*_changes(F.col("sets"))))))
    last = rows.groupBy("monitor_id").agg(F.max_by(F.struct(*fields), F.struct("at", "seq")).alias("r"))
    return found, last.select("monitor_id", "r.*")


def quarantines(threshold: int = 3, hours: int = 24, delay: int = 3600) -> Callable:
    """``(plugin_id, quarantined_at, n_failures)`` from batches ``(plugin_id, failed_at)``: a row each time a
    plugin's failures within the window reach a new height from the threshold on, the first of
    which puts it into quarantine. Failures of one second count together; those more than ``delay``
    seconds before the last of all are left out. The state is each plugin's height, its last second,
    and the failures of its last window, by second."""
    seconds = hours * 3600

    def step(failures: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = failures.select("plugin_id", "failed_at", F.unix_seconds(F.col("failed_at").cast("timestamp")).alias("t"))
        if past is not None:
            here = F.col("last").isNull() | (F.col("t") >= F.col("last"))
            new = new.join(past.select("plugin_id", "last"), "plugin_id", "left").where(here)
            new = new.crossJoin(F.broadcast(past.agg(F.max("last").alias("top")))).where(F.col("top").isNull() | (F.col("t") >= F.col("top") - delay))  # one row
        rows = new.groupBy("plugin_id", "t").agg(F.count("*").alias("c"), F.min("failed_at").alias("at"), F.lit(None).cast("long").alias("most"))
        if past is not None:
            old = past.select("plugin_id", F.inline("times"), F.lit(None).cast(new.schema["failed_at"].dataType).alias("at"), "most")
            rows = rows.unionByName(old)
        order = Window.partitionBy("plugin_id").orderBy("t")
        ever = Window.partitionBy("plugin_id")
        counted = rows.withColumn("n", F.when(F.col("at").isNotNull(), F.sum("c").over(order.rangeBetween(-seconds, 0)))).withColumn("most", F.coalesce(F.max("most").over(ever), F.lit(0)))
        height = F.greatest("most", F.coalesce(F.max("n").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = counted.withColumn("height", height).where((F.col("n") >= threshold) & (F.col("n") > F.col("height")))
        found = found.select("plugin_id", F.col("at").alias("quarantined_at"), F.col("n").alias("n_failures"))
        state = counted.withColumn("last", F.max("t").over(ever)).where(F.col("t") >= F.col("last") - seconds)
        whole = counted.groupBy("plugin_id").agg(F.max(F.greatest("most", F.coalesce("n", F.lit(0)))).alias("most"))
        times = state.groupBy("plugin_id", "last", "t").agg(F.sum("c").alias("c")).groupBy("plugin_id", "last").agg(F.collect_list(F.struct("t", "c")).alias("times"))
        return found, times.join(whole, "plugin_id")

    return step


def limited(most: int, seconds: int) -> Callable:
    """``(client, request_id)`` that pass, from batches ``(client, request_id, at)``: those that find fewer than
    ``most`` passed in the last ``seconds``. Refused requests do not count. The state is the times of a
    client's last passed requests, which is dropped where the client is silent."""

    def step(requests: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        kind = requests.schema["request_id"].dataType.simpleString()
        row = F.struct(F.unix_seconds(F.col("at").cast("timestamp")).alias("t"), "request_id")
        asked = requests.groupBy("client").agg(F.array_sort(F.collect_list(row)).alias("asked"))
        if past is None:
            both = asked.withColumn("passed", F.lit(None).cast("array<long>")).withColumn("until", F.lit(None).cast("timestamp"))
        else:
            both = asked.join(past.where(F.col("until") > F.current_timestamp()), "client", "full")
        start = F.struct(F.coalesce("passed", F.array().cast("array<long>")).alias("passed"), F.array().cast(f"array<{kind}>").alias("out"))

        def take(now: Column, r: Column) -> Column:
            full = F.size(now.passed) >= most
            kept = F.concat(F.when(full, F.slice(now.passed, 2, most)).otherwise(now.passed), F.array(r.t))
            free = ~full | (F.try_element_at(now.passed, F.lit(-most)) <= r.t - seconds)
            return F.when(free, F.struct(kept.alias("passed"), F.concat(now.out, F.array(r.request_id)).alias("out"))).otherwise(now)

        done = both.withColumn("f", F.aggregate(F.coalesce("asked", F.array()), start, take))
        until = F.when(F.col("asked").isNull(), F.col("until")).otherwise(F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds)))
        state = done.select("client", F.col("f.passed").alias("passed"), until.alias("until"))
        return done.select("client", F.explode("f.out").alias("request_id")), state

    return step


def over_batches(batches: list[DataFrame], step: Callable, name: str) -> DataFrame:
    """Runs an operator over tables that come one after the other as a stream, into a table in the shared folder.

    Micro-batch ``n`` reads ``state/n-1``, writes ``state/n`` and what it found under ``out/n``; run
    again after a failure it writes the same once more."""
    spark = batches[0].sparkSession
    base = scratch(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        past = batch.sparkSession.read.parquet(f"{base}/state/{n - 1}") if n else None
        found, state = step(batch, past)
        found.write.mode("overwrite").parquet(f"{base}/out/{n}")
        state.write.mode("overwrite").parquet(f"{base}/state/{n}")

    for b in batches:
        b.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(b.schema).parquet(f"{base}/in")
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.schema(step(batches[0], None)[0].schema).parquet(f"{base}/out/*")
