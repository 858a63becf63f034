"""Identities: clustering of co-observed entities, confidence, merge and split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators.bitmaps import DEEP, Segments, Sum, holders
from evigrid.operators.components import connected_components
from evigrid.operators.correlate import noisy_or
from evigrid.operators.heavy import Cell, frequent, in_cells
from evigrid.plans.lineage import written

# Tiers of entity types here (a domain is weak), and their weights.
TIER_TYPES = {1: ("email", "phone", "btc", "eth", "wallet", "pgp_fingerprint"), 2: ("username", "avatar_hash")}
TIER_WEIGHTS = {1: 0.85, 2: 0.50, 3: 0.20}
PROMOTE_FROM = 0.85
OLD_WEIGHTS = {"email": 0.9, "phone": 0.9, "username": 0.6, "domain": 0.4, "ip": 0.3}
OLD_PROMOTE_FROM, OLD_DEFAULT = 0.8, 0.5


def tier(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*TIER_TYPES[1]), 1).when(k.isin(*TIER_TYPES[2]), 2).otherwise(3)


def base_weight(kind: Column) -> Column:
    t = tier(kind)
    return F.when(t == 1, TIER_WEIGHTS[1]).when(t == 2, TIER_WEIGHTS[2]).otherwise(TIER_WEIGHTS[3])


def clusters(observed: DataFrame) -> DataFrame:
    """``(investigation_id, entity_id, cluster)``: entities that share evidence holding a strong one.

    ``observed`` has ``investigation_id, evidence_id, entity_id, type``. Evidence links all its
    entities to the least of them, a star and not all pairs; clusters never cross investigations,
    and an entity without links is its own.
    """
    node = F.concat_ws("\x01", F.col("investigation_id").cast("string"), F.col("entity_id").cast("string"))
    rows = observed.withColumn("node", node)
    per = rows.groupBy("investigation_id", "evidence_id").agg(F.min("node").alias("hub"), F.max((tier(F.col("type")) == 1).cast("int")).alias("strong"))
    edges = rows.join(per.where("strong = 1"), ["investigation_id", "evidence_id"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = connected_components(edges)
    nodes = rows.select("investigation_id", "entity_id", "node").distinct()
    return nodes.join(found, "node", "left").select("investigation_id", "entity_id", F.coalesce("component", "node").alias("cluster"))


def damped_weight(kind: Column, n_sources: Column) -> Column:
    """Strong types keep their weight; others grow with the logarithm of distinct sources."""
    base = base_weight(kind)
    return F.when(tier(kind) == 1, base).otherwise(F.least(F.lit(1.0), base * (1 + F.log(F.greatest(n_sources, F.lit(1)).cast("double")))))


def confidence(members: DataFrame) -> DataFrame:
    """``(identity_id, confidence, status)`` from ``(identity_id, type, n_sources)``."""
    found = members.groupBy("identity_id").agg(F.round(noisy_or(damped_weight(F.col("type"), F.col("n_sources"))), 6).alias("confidence"))
    return found.withColumn("status", F.when(F.col("confidence") >= PROMOTE_FROM, "confirmed").otherwise("tentative"))


def old_weight(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in OLD_WEIGHTS.items():
        out = F.when(F.lower(kind) == k, v).otherwise(out)
    return F.coalesce(out, F.lit(OLD_DEFAULT))


#: Entities that are told apart by a bit each, at most, and the share of all identities that makes one of them.
HOT, HOT_SHARE = 63, 0.1


def _marked(links: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(identity_id, entity_id, hot, n, bits)`` and ``(candidate, entity_id, hot, bits)``: ``bits`` says which
    hot entities an owner has, ``n`` how many entities in all. Hot are those that a tenth of all
    identities have, the 63 most frequent of them at most."""
    links, wanted = (df.distinct() for df in (links, wanted))
    owners = links.select("identity_id").distinct().count()
    top = frequent(links, F.col("entity_id"), HOT).where(F.col("n") > F.lit(HOT_SHARE * owners)).orderBy(F.desc("n"), "key")
    hot = F.broadcast(written(top.select("key", (F.row_number().over(Window.orderBy(F.desc("n"), "key")) - 1).alias("bit")), "hot"))

    def of(df: DataFrame, owner: str) -> DataFrame:
        rows = df.withColumn("key", F.xxhash64("entity_id")).join(hot, "key", "left").drop("key")
        bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")), F.lit(0).cast("long"))
        own = rows.groupBy(owner).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
        return rows.select(owner, "entity_id", F.col("bit").isNotNull().alias("hot")).join(own, owner)

    return written(of(links, "identity_id"), "marked"), written(of(wanted, "candidate").drop("n"), "marked")


def best_overlap(wanted: DataFrame, links: DataFrame, overlap: float = 0.5, shared: int = 2) -> DataFrame:
    """For each candidate set, the stored identity that shares most: ``(candidate, identity_id, n_shared, share)``.

    It has to share ``overlap`` of its own entities or ``shared`` entities; ties go to the
    larger share and then the lesser id. Repeated rows count once.

    Only entities that few have make pairs, which are compared in cells of candidates and identities
    (``heavy.in_cells``, so both have ids of one type); hot ones are bits, counted by pair. Of the identities with
    the same hot entities only the smallest, then least, can be the best for what shares hot
    entities alone, so one of each kind stands for all of them: an entity that everyone has
    makes as many pairs as there are kinds of candidates and identities.
    """
    links, wanted = _marked(links, wanted)
    both = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.col(b)))

    def nearest(cell: Cell, i: np.ndarray, j: np.ndarray) -> pa.Table:
        """The best identity of each candidate among the matches of a cell."""
        a, b, names = cell.a, cell.b, cell.names
        t, bits, n = (np.zeros(len(names), np.int64) for _ in range(3))
        t[a], bits[b], n[b] = cell.l.column("t").to_numpy(), cell.r.column("bits").to_numpy(), cell.r.column("n").to_numpy()
        pair, m = np.unique(a[i] * len(names) + b[j], return_counts=True)
        c, o = pair // max(1, len(names)), pair % max(1, len(names))
        m = m + np.bitwise_count(t[c] & bits[o])
        fits = (m / n[o] >= overlap) | (m >= shared)
        c, o, m = c[fits], o[fits], m[fits]
        place = np.zeros(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        by = np.lexsort((place[o], -(m / n[o]), -m, c))
        by = by[np.append(True, c[by][1:] != c[by][:-1])[: len(by)]]
        c, o, m = c[by], o[by], m[by]
        return pa.table([names.take(pa.array(c)), names.take(pa.array(o)), pa.array(n[o]), pa.array(m.astype(np.int64))], names=["candidate", "identity_id", "n", "n_shared"])

    def nearest_by_bits(cell: Cell) -> Iterator[pa.Table]:
        """``nearest`` of all pairs of a cell, from bitmaps: identities stand in the order of their number of
        entities and their id, so of those that share most the first is the best."""
        names = cell.names
        t, bits, n = (np.zeros(len(names), np.int64) for _ in range(3))
        t[cell.a], bits[cell.b], n[cell.b] = cell.l.column("t").to_numpy(), cell.r.column("bits").to_numpy(), cell.r.column("n").to_numpy()
        owners, size = np.unique(cell.a, return_counts=True)
        stored = np.unique(cell.b)
        place = np.zeros(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        stored = stored[np.lexsort((place[stored], n[stored]))]
        # Hot entities are keys after the others.
        cool = int(cell.lk.max()) + 1
        hot = lambda of, x: tuple(np.concatenate(v) for v in zip(*((of[(x[of] >> k) & 1 == 1], np.full(int(((x[of] >> k) & 1).sum()), cool + k)) for k in range(HOT))))
        (more_a, more_lk), (more_b, more_rk) = hot(owners, t), hot(stored, bits)
        a, lk, b, rk = (np.concatenate(v) for v in ((cell.a, more_a), (cell.lk, more_lk), (cell.b, more_b), (cell.rk, more_rk)))
        owners = owners[np.argsort(-size, kind="stable")]
        rank = np.zeros(len(names), np.int64)
        rank[owners] = np.arange(len(owners))
        order = np.argsort(rank[a], kind="stable")
        cuts = np.searchsorted(rank[a][order], np.arange(0, len(owners) + DEEP, DEEP))
        parts = [(k * DEEP, Segments(np.zeros(e - s, np.int64), rank[a[order[s:e]]] - k * DEEP, lk[order[s:e]], DEEP)) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
        most, best = np.zeros(len(owners), np.int64), np.full(len(owners), -1)
        for known, keys in holders(rk, b, cool + HOT, stored):
            words = keys.shape[1]
            there = np.packbits(np.arange(64 * words) < len(known), bitorder="little").view(np.uint64)

            def first(x: np.ndarray) -> np.ndarray:
                """The first right owner of each row of bits, which has one."""
                word = (x != 0).argmax(axis=1)
                v = x[np.arange(len(x)), word]
                return 64 * word + np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1))

            for s, rows in parts:
                e = min(s + DEEP, len(owners))
                total = Sum(e - s, words)
                total.rows(rows, keys)
                x, m = np.broadcast_to(there, (e - s, words)), np.zeros(e - s, np.int64)
                for k in reversed(range(len(total.planes))):
                    y = x & total.planes[k]
                    has = y.any(axis=1)
                    x, m = np.where(has[:, None], y, x), m + (has.astype(np.int64) << k)
                at = first(x)
                fits = (m > 0) & ((m / n[known[at]] >= overlap) | (m >= shared))
                # Fewer may fit where the most do not: these are tried one number after the other.
                for fewer in range(int(m[~fits].max(initial=0)) - 1, 0, -1):
                    left = np.flatnonzero(~fits & (m > fewer))
                    if len(left):
                        y = np.broadcast_to(there, (len(left), words))
                        for k, p in enumerate(total.planes):
                            y = y & (p[left] if fewer >> k & 1 else ~p[left])
                        f = first(y)
                        good = y.any(axis=1) & ((fewer / n[known[f]] >= overlap) | (fewer >= shared))
                        at[left[good]], m[left[good]], fits[left[good]] = f[good], fewer, True
                better = fits & (m > most[s:e])
                most[s:e][better], best[s:e][better] = m[better], known[at[better]]
        c = np.flatnonzero(best >= 0)
        o = best[c]
        yield pa.table([names.take(pa.array(owners[c])), names.take(pa.array(o)), pa.array(n[o]), pa.array(most[c])], names=["candidate", "identity_id", "n", "n_shared"])

    kind = links.schema["identity_id"].dataType
    asking = wanted.where("NOT hot").select(F.col("candidate").cast(kind).alias("candidate"), "entity_id", F.col("bits").alias("t"))
    stored = links.where("NOT hot").select("identity_id", "entity_id", "n", "bits")
    of = kind.simpleString()
    close = in_cells(asking, stored, ["entity_id"], "candidate", "identity_id", nearest, f"candidate {of}, identity_id {of}, n long, n_shared long", nearest_by_bits)

    kinds = links.where("hot").groupBy("entity_id", "bits").agg(F.min(F.struct("n", "identity_id")).alias("least"))
    asked = wanted.where("hot").select("entity_id", F.col("bits").alias("t")).distinct()
    pairs = asked.join(kinds, "entity_id").select("t", "bits", "least.*").distinct()
    fit = (F.col("n_shared") / F.col("n") >= overlap) | (F.col("n_shared") >= shared)
    rank = F.min(F.struct((-F.col("n_shared")).alias("m"), (-F.col("n_shared") / F.col("n")).alias("s"), "identity_id", "n")).alias("best")
    by_kind = pairs.withColumn("n_shared", both("t", "bits")).where(fit).groupBy("t").agg(rank)
    owners = wanted.where("hot").select("candidate", F.col("bits").alias("t")).distinct()
    common = owners.join(by_kind, "t").select("candidate", "best.identity_id", "best.n", (-F.col("best.m")).alias("n_shared"))

    found = close.unionByName(common).groupBy("candidate").agg(rank)
    return found.select("candidate", "best.identity_id", (-F.col("best.m")).cast("long").alias("n_shared"), (-F.col("best.s")).alias("share"))


def contained_in(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored identities all of whose entities are in a candidate set: ``(candidate, identity_id)``, least id first.

    An identity never comes first if one of its entities is all that an identity with a lesser id has:
    a set that holds the former holds the latter, so it is left out.
    A set can only be inside another that has its rarest entity (among candidates), so identities are
    looked up by that one alone (the prefix of a full overlap), and the few pairs are checked entity by
    entity. Identities with hot entities only are compared by their bits, one for each kind. Repeated
    rows count once.
    """
    links, wanted = _marked(links, wanted)
    single = links.where("n = 1").groupBy("entity_id").agg(F.min("identity_id").alias("single"))
    first = links.join(single, "entity_id", "left").groupBy("identity_id").agg(F.min("single").alias("single")).where("single IS NULL OR single >= identity_id")
    links = written(links.join(first.select("identity_id"), "identity_id"), "first")
    often = wanted.groupBy("entity_id").agg(F.count("*").alias("often"))
    cool = links.where("NOT hot").join(often, "entity_id", "left").na.fill(0, ["often"]).groupBy("identity_id", "n", "bits").agg(F.min_by("entity_id", F.struct("often", "entity_id")).alias("entity_id"))
    tried = wanted.where("NOT hot").withColumnRenamed("bits", "t").join(cool, "entity_id")
    tried = tried.where(F.col("bits").bitwiseAND(F.col("t")) == F.col("bits")).select("candidate", "identity_id", "n", "bits")
    rest = tried.join(links.where("NOT hot").select("identity_id", "entity_id"), "identity_id")
    held = rest.join(wanted.where("NOT hot").select("candidate", "entity_id"), ["candidate", "entity_id"])
    whole = held.groupBy("candidate", "identity_id", "n", "bits").agg(F.count("*").alias("m")).where(F.col("m") + F.bit_count("bits") == F.col("n"))

    kinds = links.where("hot AND n = bit_count(bits)").groupBy("bits").agg(F.min("identity_id").alias("identity_id"), F.min("entity_id").alias("entity_id"))
    asked = wanted.where("hot").select("entity_id", F.col("bits").alias("t")).distinct()
    inside = asked.join(kinds, "entity_id").where(F.col("bits").bitwiseAND(F.col("t")) == F.col("bits")).groupBy("t").agg(F.min("identity_id").alias("identity_id"))
    common = wanted.where("hot").select("candidate", F.col("bits").alias("t")).distinct().join(inside, "t").select("candidate", "identity_id")
    return whole.select("candidate", "identity_id").unionByName(common).groupBy("candidate").agg(F.min("identity_id").alias("identity_id"))


def merged_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Links after merges ``(source_id, target_id)``: moved to the target, the higher weight kept."""
    moved = links.join(merges.where("source_id <> target_id"), links.identity_id == merges.source_id, "left")
    return moved.select(
        F.coalesce("target_id", "identity_id").alias("identity_id"), "entity_id", "signal_weight",
    ).groupBy("identity_id", "entity_id").agg(F.max("signal_weight").alias("signal_weight"))


def split_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """Undoes merges: ``records`` has ``source_id, target_id, moved`` (entity -> weight)."""
    back = records.select("source_id", "target_id", F.explode("moved").alias("entity_id", "signal_weight"))
    gone = back.select(F.col("target_id").alias("identity_id"), "entity_id")
    kept = links.join(gone, ["identity_id", "entity_id"], "left_anti")
    return kept.unionByName(back.select(F.col("source_id").alias("identity_id"), "entity_id", "signal_weight"))
