"""Analytical reads: search, pages, roll-ups, timelines, comparison, retention."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTABLE = ("created_at", "status", "target", "id")


def filtered(df: DataFrame, contains: dict[str, str] | None = None, **equals) -> DataFrame:
    """Optional filters: those that are given must all hold; texts are contained without case."""
    conds = [F.col(k) == v for k, v in equals.items() if v is not None]
    conds += [F.col(k).ilike(f"%{v}%") for k, v in (contains or {}).items() if v]
    return df.where(reduce(Column.__and__, conds)) if conds else df


def page(df: DataFrame, sort: str, descending: bool, key: str, offset: int, size: int) -> DataFrame:
    """One page in a total order: the sort column, then the key."""
    if sort not in df.columns:
        raise ValueError(f"cannot sort by {sort}")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(order, key).offset(offset).limit(size)


def search(branches: list[tuple[str, DataFrame, str, list[str]]], text: str, per_branch: int, most: int) -> DataFrame:
    """``(branch, id, title)``: in each branch ``(name, rows, id column, searched columns)`` the first
    ``per_branch`` rows in which a column contains the text, then the first ``most`` of all."""
    if len(text) < 2:
        raise ValueError("search text is too short")
    out = None
    for n, (name, df, key, cols) in enumerate(branches):
        hit = reduce(Column.__or__, (F.col(c).ilike(f"%{text}%") for c in cols))
        got = df.where(hit).select(
            F.lit(n).alias("branch_no"), F.lit(name).alias("branch"), F.col(key).cast("long").alias("id"),
            F.substring(cols[0], 1, 80).alias("title"),
        ).orderBy("id").limit(per_branch)
        out = got if out is None else out.unionByName(got)
    return out.orderBy("branch_no", "id").limit(most).drop("branch_no")


def child_counts(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """Number of children of each parent, 0 included; children are counted before the join."""
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias("n_children"))
    return parents.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, state)``: only_in_1, only_in_2, changed or same."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_x")), b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_y"))
    state = F.when(F.col("_y").isNull(), "only_in_1").when(F.col("_x").isNull(), "only_in_2").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return x.join(y, key, "full_outer").select(key, state.alias("state"))


def timeline(parts: list[DataFrame], completion: DataFrame | None, key: str = "investigation_id") -> DataFrame:
    """Events in order of their time as text, padded; a completion comes last whatever its time."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("last", F.lit(0)) for p in parts))
    if completion is not None:
        rows = rows.unionByName(completion.withColumn("last", F.lit(1)))
    w = Window.partitionBy(key).orderBy("last", F.rpad("at", 32, " "), "kind", "detail")
    return rows.withColumn("place", F.row_number().over(w)).drop("last")


def expired(parents: DataFrame, cutoff: Column, key: str, at: str = "created_at") -> DataFrame:
    return parents.where(F.col(at) < cutoff).select(key)


def retained(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(gone, key, "left_anti")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)


def allowed_requests(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """``(client, request_id)`` that a sliding-window limiter lets pass: a request passes if fewer than
    ``most`` passed in the last ``seconds``. Refused requests do not count, so requests are walked in
    time, a request of equal time by its id.

    A client's time is cut where it is silent for a whole stretch of ``seconds``: nothing is
    remembered across. The pieces of all clients are dealt over tasks, sorted, and walked with the
    last ``most`` times in memory.
    """
    at = requests.select("client", "request_id", F.col("at").cast("timestamp").cast("long").alias("t")).withColumn("stretch", F.floor(F.col("t") / seconds))
    # Stretches with requests, next to each other, make a piece; there are as many as time is long, not as requests.
    busy = at.select("client", "stretch").distinct()
    pieces = busy.withColumn("piece", F.col("stretch") - F.row_number().over(Window.partitionBy("client").orderBy("stretch")))
    dealt = at.join(pieces, ["client", "stretch"]).select("client", "piece", "t", "request_id")
    dealt = dealt.repartition("client", "piece").sortWithinPartitions("client", "piece", "t", "request_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passed = None, deque(maxlen=most)
        for b in batches:
            keep = []
            for client, piece, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (client, piece) != now:
                    now, passed = (client, piece), deque(maxlen=most)
                ok = len(passed) < most or passed[0] <= t - seconds
                if ok:
                    passed.append(t)
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_())).select(["client", "request_id"])


    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in ("client", "request_id"))
    return dealt.mapInArrow(walk, kinds)


def of_owner(children: DataFrame, parents: DataFrame, owner: Column, key: str) -> DataFrame:
    """Children whose parent belongs to the owner."""
    return children.join(parents.where(owner).select(key), key, "left_semi")


def search_payloads(evidence: DataFrame, parents: DataFrame, owner: Column, text: str, key: str = "investigation_id", payload: str = "raw") -> DataFrame:
    """Evidence of the owner whose payload, as text, contains ``text`` in any case."""
    if len(text) < 2:
        raise ValueError("search text is too short")
    return of_owner(evidence.where(F.col(payload).ilike(f"%{text}%")), parents, owner, key)


def tagged(associations: DataFrame, tags: DataFrame, kind: str) -> DataFrame:
    """``(entity_id, tags)``: names of the tags of objects of one kind, sorted."""
    found = associations.where(F.col("entity_type") == kind).join(tags, "tag_id")
    return found.groupBy("entity_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))


def previous_evidence(monitors: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of the investigation that each monitor ran last."""
    return monitors.where("last_investigation_id IS NOT NULL").join(evidence.withColumnRenamed("investigation_id", "last_investigation_id"), "last_investigation_id")
