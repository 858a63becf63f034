"""Replay of an identity log without walking it: where every link ends, by pointers over its merges.

A merge moves all links of an identity to its target. So a link that starts at an identity leaves
it by the identity's first merge after that moment, leaves the target by *its* first merge after
that, and so on: merges form a forest, each pointing to the next one. Doubled pointers give every
chain's end in log2(length) rounds, whatever the number of identities that merges tie together.
Splits take single entities away from an identity and start new links; only entities that occur
in splits, and those that several links bring to one identity, have the merges of their chain
enumerated, by the same pointers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators.correlate import noisy_or
from evigrid.operators.heavy import frequent
from evigrid.operators.identity import PROMOTE_FROM, tier
from evigrid.plans.lineage import ROWS, partitions, tasks, written


def following(points: DataFrame, marks: DataFrame, keys: tuple[str, ...], whole: int = ROWS) -> DataFrame:
    """``points`` with ``next``: the least later ``o`` of ``marks`` of the same keys; null if there is none.

    Keys of up to ``whole`` rows are read in one piece. If a sketch finds a key of more, rows are dealt
    by range of (keys, ``o``), so that it is cut into pieces; the first mark of each piece is then handed
    to the pieces before it. Points and marks are read several times.
    """
    both = points.withColumn("_mark", F.lit(0)).unionByName(marks.select(*keys, "o", F.lit(1).alias("_mark")), allowMissingColumns=True)
    mark = F.when(F.col("_mark") == 1, F.col("o"))
    # Equal moments do not follow each other: points come first, looking back from the end.
    back = lambda *by: Window.partitionBy(*keys, *by).orderBy(F.desc("o"), "_mark").rowsBetween(Window.unboundedPreceding, -1)
    many = math.ceil(both.count() / whole)
    if many < 2 or frequent(both, F.struct(*keys), many).where(F.col("n") > whole).isEmpty():
        found = both.withColumn("next", F.last(mark, ignorenulls=True).over(back())).where("_mark = 0")
        return found.select(*points.columns, "next")
    dealt = both.repartitionByRange(partitions(points.sparkSession), *keys, "o").withColumn("_piece", F.spark_partition_id())
    dealt = written(dealt, "dealt")
    here = dealt.withColumn("_here", F.last(mark, ignorenulls=True).over(back("_piece"))).where("_mark = 0")
    pieces = dealt.groupBy(*keys, "_piece").agg(F.min(mark).alias("_first"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    handed = pieces.select(*keys, "_piece", F.last("_first", ignorenulls=True).over(beyond).alias("_beyond")).where("_beyond IS NOT NULL")
    found = here.join(handed, [*keys, "_piece"], "left")
    return found.select(*points.columns, F.coalesce("_here", "_beyond").alias("next"))


def _steps(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``(node, up)``: the 2^k-th node further on, for those that have one."""
    out = []
    now = written(nodes.where("up IS NOT NULL").select("node", "up"), "pointers")
    while not now.isEmpty():
        out.append(now)
        a, b = now.alias("a"), now.alias("b")
        now = written(a.join(b, F.col("a.up") == F.col("b.node")).select("a.node", "b.up"), "pointers")
    return out


def _ends(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``(node, last)``: the end of each node's chain, itself if nothing follows."""
    now = nodes.select("node", F.col("node").alias("last"))
    for s in reversed(steps):
        now = now.join(s.withColumnsRenamed({"node": "last"}), "last", "left").select("node", F.coalesce("up", "last").alias("last"))
    return now


def _chains(starts: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``(start, node)`` for every node on the chain of each start."""
    now = starts.select(F.col("node").alias("start"), "node")
    for s in steps:
        now = written(now.unionByName(now.join(s, "node").select("start", F.col("up").alias("node"))), "chains")
    return now


def numbered(log: DataFrame) -> DataFrame:
    """``(o, identity_id, action, target_id, entities)``: the events of a log with their place in its order as
    one number ``o``, which aggregates in place and sorts as it is. A numbered log stays as it is."""
    if "o" in log.columns:
        return log
    text = lambda c: F.col(c).cast("string").alias(c)
    order = ["at", "log", "seq"]
    rows = log.select(*order, text("identity_id"), "action", text("target_id"), "entities")
    rows = rows.repartitionByRange(tasks(log), *order).sortWithinPartitions(*order)
    return written(rows.select(F.monotonically_increasing_id().alias("o"), "identity_id", "action", "target_id", "entities"), "log")


def replayed_links(log: DataFrame) -> DataFrame:
    """``(identity_id, entity_id, signal_weight)`` that the log leaves, from nothing.

    ``log`` has ``at, log, seq, identity_id, action, target_id, entities`` (entity to weight: what an
    identity was created with, or what a split moves back); (at, log, seq) tells events apart. The
    first event of an identity makes it; a merge moves its links to the target, which keeps a
    weight of its own; a merge into itself loses them; a split moves the given ones back. An empty
    log leaves none.
    """
    rows = numbered(log)
    # A merge is told by its ``o``: the node of a link's chain, and the moment at which the link leaves.
    merges = rows.where("action = 'merged' AND target_id IS NOT NULL").select("o", "identity_id", "target_id")
    arrivals = merges.where("identity_id <> target_id").select(F.col("target_id").alias("identity_id"), "o")

    named = rows.select("identity_id", "o").unionByName(merges.select(F.col("target_id").alias("identity_id"), "o"))
    first = named.groupBy("identity_id").agg(F.min("o").alias("o"))
    made = rows.where("action = 'created'").join(first, ["identity_id", "o"], "left_semi")
    split = rows.where("action = 'split' AND target_id IS NOT NULL")
    each = F.explode("entities").alias("entity_id", "signal_weight")
    tokens = made.select("identity_id", "o", each).unionByName(split.select("identity_id", "o", each))
    tokens = written(tokens.withColumn("token", F.monotonically_increasing_id()), "tokens")
    placed = written(following(tokens.unionByName(arrivals, allowMissingColumns=True), merges, ("identity_id",)), "placed")
    nodes = placed.where("token IS NULL").select(F.col("o").alias("node"), "identity_id", F.col("next").alias("up"))
    tokens = placed.where("token IS NOT NULL").withColumnRenamed("next", "start")
    moved = split.select("identity_id", "target_id", "o", each)
    takes = written(moved.select("identity_id", "entity_id", "o").unionByName(moved.select(F.col("target_id").alias("identity_id"), "entity_id", "o")), "takes")

    # A chain that ends in a merge into itself ends nowhere: that is no node.
    steps = _steps(nodes)
    target = nodes.select(F.col("node").alias("last"), F.col("identity_id").alias("final"))
    ends = _ends(nodes, steps).join(target, "last").select(F.col("node").alias("start"), "final")
    stay = tokens.where("start IS NULL").withColumn("final", F.col("identity_id"))
    ended = written(stay.unionByName(tokens.where("start IS NOT NULL").join(ends, "start")), "ended")

    # Links of entities that splits take: where they are, from when to when, and whether they are taken there.
    touched = ended.join(takes.select("entity_id").distinct(), "entity_id", "left_semi")
    begin = touched.select("token", "entity_id", "identity_id", "o", F.col("start").alias("leave"))
    visits = written(begin.unionByName(_visits(touched, nodes, steps)), "visits")
    hit = following(visits, takes, ("identity_id", "entity_id")).where("next IS NOT NULL AND (leave IS NULL OR next < leave)")
    alive = written(ended.join(hit.select("token").distinct(), "token", "left_anti"), "alive")

    # Of several links to one entity the one that was there first stays, at every identity on the way:
    # arrivals are compared from the last identity back.
    n = alive.groupBy("final", "entity_id").agg(F.count("*").alias("n"))
    several = alive.join(n.where("n > 1"), ["final", "entity_id"], "left_semi")
    way = several.select("token", "o").unionByName(_visits(several, nodes, steps).select("token", "o"))
    way = way.groupBy("token").agg(F.sort_array(F.collect_list("o"), asc=False).alias("way"))
    best = several.join(way, "token").groupBy("final", "entity_id").agg(F.min_by("signal_weight", "way").alias("signal_weight"))
    alone = alive.join(n.where("n = 1"), ["final", "entity_id"], "left_semi").select("final", "entity_id", "signal_weight")
    return alone.unionByName(best).withColumnRenamed("final", "identity_id")


def _visits(tokens: DataFrame, nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``(token, entity_id, identity_id, o, leave)``: every identity that links are moved to, and when."""
    starts = tokens.where("start IS NOT NULL").select(F.col("start").alias("node")).distinct()
    on = _chains(starts, steps).join(nodes, "node").select("start", "identity_id", F.col("node").alias("o"), F.col("up").alias("leave"))
    return tokens.select("token", "entity_id", "start").join(on, "start").select("token", "entity_id", "identity_id", "o", "leave")


def replayed_states(log: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """``(identity_id, status, merged_into, confidence)`` after the log, rescored.

    ``links`` are those that ``replayed_links`` gives; ``entities`` has ``entity_id, type, n_sources``.
    Creation matters only where an identity is new, and a merge only with a target. Identities that
    are not merged get the noisy-OR of their links' weights, which grow with the logarithm of the
    sources but for strong types; a tentative one with enough is confirmed.
    """
    rows = numbered(log).where("action IN ('created', 'promoted', 'disputed', 'split') OR action = 'merged' AND target_id IS NOT NULL")
    merging, telling = F.col("action").isin("merged", "split"), F.col("action") != "created"
    states = rows.groupBy("identity_id").agg(
        F.max_by("action", F.when(telling, F.col("o"))).alias("last"),
        F.max_by(F.when(F.col("action") == "merged", F.col("target_id")), F.when(merging, F.col("o"))).alias("merged_into"),
    )
    status = F.when(F.col("last") == "promoted", "confirmed").when(F.col("last").isin("disputed", "merged"), F.col("last")).otherwise("tentative")
    known = links.join(entities, "entity_id", "left")
    grown = F.least(F.lit(1.0), F.col("signal_weight") * (1 + F.log(F.greatest("n_sources", F.lit(1)).cast("double"))))
    weight = F.when((tier(F.col("type")) == 1) | F.col("n_sources").isNull(), F.col("signal_weight")).otherwise(grown)
    scores = known.groupBy("identity_id").agg(F.round(noisy_or(weight), 6).alias("score"))
    found = states.withColumn("status", status).join(scores, "identity_id", "left")
    score = F.when(F.col("status") == "merged", 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    risen = (F.col("status") == "tentative") & (F.col("confidence") >= PROMOTE_FROM)
    return found.withColumn("confidence", score).select("identity_id", F.when(risen, "confirmed").otherwise(F.col("status")).alias("status"), "merged_into", "confidence")


def differences(before: DataFrame, after: DataFrame, links_before: DataFrame, links_after: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``(identity_id, entity_id, difference)`` of two states and their links; none: the replay is verified.

    Identities are missing, extra, or differ in ``status``, ``merged_into`` or ``confidence`` (a row for
    each); links are missing or extra, with their entity.
    """
    fields = ("status", "merged_into", "confidence")
    side = lambda df, n: df.select("identity_id", F.struct(*fields).alias(n))
    both = side(before, "a").join(side(after, "b"), "identity_id", "full_outer")
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("b").isNull(), "missing"), F.when(F.col("a").isNull(), "extra"),
        F.when(here & ~F.col("a.status").eqNullSafe(F.col("b.status")), "status"),
        F.when(here & ~F.col("a.merged_into").eqNullSafe(F.col("b.merged_into")), "merged_into"),
        F.when(here & (F.abs(F.col("a.confidence") - F.col("b.confidence")) > tolerance), "confidence"),
    ))
    states = both.select("identity_id", F.lit(None).cast("string").alias("entity_id"), F.explode(kinds).alias("difference"))
    keys = ["identity_id", "entity_id"]
    one = lambda df, n: df.select(*keys, F.lit(True).alias(n))
    links = one(links_before, "a").join(one(links_after, "b"), keys, "full_outer")
    kind = F.when(F.col("b").isNull(), "missing link").when(F.col("a").isNull(), "extra link")
    return states.unionByName(links.select(*keys, kind.alias("difference")).where("difference IS NOT NULL"))
