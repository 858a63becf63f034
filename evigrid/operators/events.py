"""Event logs: decisions as events, state as their fold, and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decision_events(decisions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Events of decisions that were not processed before, in their order.

    ``decisions`` has ``decision_id, kind, draft, known, decided_at``; ``done`` has
    ``decision_id``. Each gives requested, evaluated and an outcome.
    """
    w = Window.partitionBy("decision_id").orderBy("decided_at", "kind")
    new = decisions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if done is not None:
        new = new.join(done.select("decision_id").distinct(), "decision_id", "left_anti")
    outcome = F.when(F.col("kind") == "reject", "rejected").when(F.col("kind") == "queue_review", "queued").otherwise("executed")
    steps = F.posexplode(F.array(F.lit("requested"), F.lit("evaluated"), outcome)).alias("seq", "event")
    return new.select("*", steps)


#: What a review item may become.
TRANSITIONS = {("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("approved", "execute"): "executed"}


def review_states(actions: DataFrame) -> DataFrame:
    """``(decision_id, status)``: a fold of actions in order; those that do not fit are ignored."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("at", "action"))), lambda x: x["action"])
    step = F.when
    fold = lambda s, a: step((s == "pending") & (a == "approve"), "approved").when((s == "pending") & (a == "reject"), "rejected").when((s == "approved") & (a == "execute"), "executed").otherwise(s)
    return actions.groupBy("decision_id").agg(F.aggregate(seq, F.lit("pending"), fold).alias("status"), F.count("*").alias("n_actions"))


def status_fold(events: DataFrame) -> DataFrame:
    """``(identity_id, status, confidence)``: the last event decides; a partial aggregate, no sort."""
    order = F.struct("at", "log", "seq")
    state = F.when(F.col("last") == "created", "tentative").when(F.col("last") == "promoted", "confirmed").when(F.col("last") == "disputed", "disputed").when(F.col("last") == "merged", "merged").otherwise("tentative")
    return events.groupBy("identity_id").agg(F.max_by("action", order).alias("last"), F.count("*").alias("n_events")).withColumn("status", state).drop("last")


def active(states: DataFrame) -> DataFrame:
    """Identities that were not merged into others."""
    return states.where(F.col("status") != "merged")


def merged_log(identity: DataFrame, decision: DataFrame) -> DataFrame:
    """Both logs as one, in time; identity events come first at equal times."""
    cols = ["at", "log", "seq", "identity_id", "action"]
    return identity.withColumn("log", F.lit(0)).select(*cols).unionByName(decision.withColumn("log", F.lit(1)).select(*cols)).orderBy("at", "log", "seq", "identity_id", "action")


def state_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Identities that are in one snapshot only, or differ in status or confidence."""
    x, y = (df.select("identity_id", F.col("status").alias(f"status_{n}"), F.col("confidence").alias(f"confidence_{n}")) for n, df in (("a", a), ("b", b)))
    joined = x.join(y, "identity_id", "full_outer")
    kind = F.when(F.col("status_b").isNull(), "only_a").when(F.col("status_a").isNull(), "only_b").when(F.col("status_a") != F.col("status_b"), "status").when(
        F.abs(F.col("confidence_a") - F.col("confidence_b")) > tolerance, "confidence",
    )
    return joined.withColumn("difference", kind).where("difference IS NOT NULL")


def latest(changes: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """State from change rows with partial updates: the last non-null value of each field. A row
    with ``deleted`` ends its key until a later one starts it again."""
    at = F.struct(*order)
    ends = changes.groupBy(*keys).agg(F.max(F.when(F.col("deleted"), at)).alias("_gone"))
    rows = changes.join(ends, list(keys)).where(F.col("_gone").isNull() | (at > F.col("_gone")))
    return rows.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def merge_records(merges: DataFrame, links: DataFrame) -> DataFrame:
    """``(decision_id, source_id, target_id, moved)`` of automatic merges: ``moved`` maps the entities that the
    source has then to their weights, for a later split."""
    own = links.groupBy(F.col("identity_id").alias("source_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_id", "signal_weight")))).alias("moved")
    )
    empty = F.create_map().cast("map<string,double>")
    return merges.join(own, "source_id", "left").select("decision_id", "source_id", "target_id", F.coalesce("moved", empty).alias("moved"))


def audit_trail(items: DataFrame, log: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Events of the decisions behind review items: ``(item_id, decision_id, place, event)`` in their order.

    Events of one moment and number go by the columns ``ties`` of the log, then by name, so
    that the places do not depend on how the log is dealt to tasks.
    """
    joined = items.select("item_id", "decision_id").join(log, "decision_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("at", "seq", *ties, "event"))
    return joined.select("item_id", "decision_id", place.alias("place"), "event")
