"""Replay by pointers against a walk of the whole log; batches against one ingestion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import ingest, replay
from evigrid.queries import records

SF = "/root/testdata/sf0.001"
LOG = "at long, log int, seq long, identity_id string, action string, target_id string, entities map<string,double>"


def walk(rows):
    """Links after a log, one event at a time over everything."""
    where, known = {}, set()  # (identity, entity) -> weight
    for r in sorted(rows, key=lambda r: (r["at"], r["log"], r["seq"])):
        i, t = str(r["identity_id"]), None if r["target_id"] is None else str(r["target_id"])
        if r["action"] == "created" and i not in known:
            where |= {(i, e): w for e, w in (r["entities"] or {}).items()}
        if r["action"] == "merged" and t:
            for (_, e), w in [x for x in where.items() if x[0][0] == i]:
                del where[(i, e)]
                if t != i:
                    where.setdefault((t, e), w)
            known.add(t)
        if r["action"] == "split" and t:
            for e, w in (r["entities"] or {}).items():
                where.pop((t, e), None)
                where[(i, e)] = w
        known.add(i)
    return where


def states(rows, links, entities):
    """Status, merge and confidence after a log, by the rules for one event at a time."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["log"], r["seq"])):
        i, t, a = r["identity_id"], r["target_id"], r["action"]
        if a == "created":
            out.setdefault(i, ["tentative", None])
        elif a in ("promoted", "disputed"):
            out.setdefault(i, ["", None])[0] = {"promoted": "confirmed"}.get(a, a)
        elif a == "merged" and t is not None:
            out[i] = ["merged", t]
        elif a == "split":
            out[i] = ["tentative", None]
    none = dict.fromkeys(out, 1.0)
    for (i, e), w in links.items():
        kind, n = entities.get(e, (None, None))
        none[i] = none.get(i, 1.0) * (1 - max(0, min(1, w if kind == "email" or n is None else w * (1 + math.log(max(n, 1))))))
    found = {}
    for i, (status, into) in out.items():
        score = 0.0 if status == "merged" else round(1 - none[i], 6)
        found[i] = ("confirmed" if status == "tentative" and score >= 0.85 else status, into, pytest.approx(score, abs=1e-6))
    return found


def check(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], LOG).repartition(3)
    got = replay.replayed_links(df)
    links = {(r.identity_id, r.entity_id): r.signal_weight for r in got.collect()}
    assert links == walk(rows)
    kinds = {"e1": ("email", 5), "e2": ("username", 3), "e3": ("domain", 1)}
    entities = spark.createDataFrame([(e, *x) for e, x in kinds.items()], "entity_id string, type string, n_sources long")
    found = replay.replayed_states(df, got, entities).collect()
    assert {r.identity_id: (r.status, r.merged_into, r.confidence) for r in found} == states(rows, links, kinds)
    return links


def event(seq, i, action, target=None, entities=None, at=None):
    return {"at": seq // 3 if at is None else at, "log": 0, "seq": seq, "identity_id": i, "action": action, "target_id": target, "entities": entities}


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    """Merges back and forth, into oneself, of identities that are made later; splits of what is there and what is not."""
    rnd = random.Random(seed)
    names, ents = [f"i{k}" for k in range(9)], [f"e{k}" for k in range(5)]
    rows = []
    for k in range(220):
        action = rnd.choice(["created", "created", "merged", "merged", "merged", "split", "promoted", "disputed"])
        target = rnd.choice([*names, None]) if action in ("merged", "split") else None
        held = {e: round(rnd.random(), 3) for e in rnd.sample(ents, rnd.randint(0, 2))} if action in ("created", "split") else None
        rows.append(event(k, rnd.choice(names), action, target, held))
    assert check(spark, rows)


def test_a_chain_of_ten_thousand_merges(spark):
    """Every identity is merged into the next, the links of all end at the last; one split on the way."""
    n = 10_000
    rows = [event(k, f"i{k}", "created", None, {"e1": 0.5, f"own{k}": 0.1} if k % 50 == 0 else {}, at=0) for k in range(n + 1)]
    rows += [event(n + 1 + 2 * k, f"i{k}", "merged", f"i{k + 1}", at=k + 1) for k in range(n)]
    rows += [event(n + 2 + 2 * 7000, "x", "split", "i7001", {"own50": 0.9}, at=7001)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], LOG)
    got = {(r.identity_id, r.entity_id): r.signal_weight for r in replay.replayed_links(df).collect()}
    want = {(f"i{n}", f"own{k}"): 0.1 for k in range(0, n + 1, 50) if k != 50} | {(f"i{n}", "e1"): 0.5, ("x", "own50"): 0.9}
    assert got == want


def test_a_hub_of_merges(spark):
    """A third of all events merge into one identity, which is merged on now and then."""
    rows = [event(k, f"i{k}", "created", None, {f"e{k % 7}": k / 1000}, at=0) for k in range(600)]
    rows += [event(1000 + k, f"i{k}", "merged", "hub", at=1 + k // 4) for k in range(600)]
    rows += [event(5000 + k, "hub", "merged", f"end{k % 3}", at=20 * k + 9) for k in range(7)]
    check(spark, rows)


@pytest.mark.parametrize("whole", [50, 1000])
def test_following_whole_keys_and_pieces(spark, whole):
    """The next mark of a key, also of one with more rows than are read in one piece."""
    rnd = random.Random(whole)
    points, marks = ([(rnd.choice(["hub", "hub", f"i{rnd.randrange(20)}", None]), rnd.randrange(400)) for _ in range(300)] for _ in range(2))
    df = lambda rows: spark.createDataFrame(rows, "k string, o long")
    got = replay.following(df(points), df(marks), ("k",), whole).collect()
    want = [(k, o, min((m for j, m in marks if j == k and m > o), default=None)) for k, o in points if k]
    assert sorted(map(str, map(tuple, (r for r in got if r.k)))) == sorted(map(str, want))


def test_events_are_numbered_in_their_order(spark):
    """One number tells the order, so that the first and last event of an identity aggregate without a sort."""
    rows = [event(k, f"i{k % 5}", "promoted", at=(k * 7) % 11) for k in range(200)]
    log = replay.numbered(spark.createDataFrame([tuple(r.values()) for r in rows], LOG).withColumn("entities", F.create_map(F.lit("seq"), F.col("seq").cast("double"))).repartition(5))
    got = [int(r.entities["seq"]) for r in log.orderBy("o").collect()]
    assert got == [r["seq"] for r in sorted(rows, key=lambda r: (r["at"], r["log"], r["seq"]))]
    assert replay.numbered(log) is log


def test_the_log_of_the_tables_and_none(spark):
    log = records.replay_log(spark, SF)
    got = {(r.identity_id, r.entity_id): r.signal_weight for r in replay.replayed_links(log).collect()}
    assert got == walk([r.asDict() for r in log.collect()]) and len(got) > 10
    assert replay.replayed_links(log.limit(0)).count() == 0


def test_differences_of_states(spark):
    a = spark.createDataFrame([("1", "tentative", None, 0.5), ("2", "merged", "1", 0.0), ("3", "confirmed", None, 0.9)], "identity_id string, status string, merged_into string, confidence double")
    b = spark.createDataFrame([("1", "confirmed", None, 0.5005), ("2", "merged", "3", 0.5), ("4", "tentative", None, 0.0)], a.schema)
    x, y = (spark.createDataFrame(v, "identity_id string, entity_id string") for v in ([("1", "e"), ("3", "f")], [("1", "e"), ("4", "g")]))
    got = {tuple(r) for r in replay.differences(a, b, x, y).collect()}
    assert got == {("1", None, "status"), ("2", None, "merged_into"), ("2", None, "confidence"), ("3", None, "missing"), ("4", None, "extra"), ("3", "f", "missing link"), ("4", "g", "extra link")}


def test_batches_count_an_investigation_once(spark):
    """Three batches give what one does, whatever investigations come again."""
    rnd = random.Random(1)
    rows = [("email", f"v{rnd.randrange(4)}", f"raw{k}", k, rnd.choice([None, "a", "b", "c", "d"]), k) for k in range(60)]
    seen = spark.createDataFrame(rows, "type string, normalized_value string, raw_value string, seen_at long, investigation_id string, seq long")
    stored = links = None
    for k in range(3):
        stored, links = ingest.ingested(seen.where(F.col("seq") % 3 == k), stored, links)
    want = {(r.normalized_value, r.first_seen, r.last_seen, r.source_count, r.investigation_count) for r in ingest.upserted_entities(seen).collect()}
    got = {(r.normalized_value, r.first_seen, r.last_seen, r.source_count, r.investigation_count) for r in stored.collect()}
    assert got == want and links.count() == len({(r[1], r[4]) for r in rows if r[4]})
    with pytest.raises(ValueError, match="links"):
        ingest.upserted_entities(seen, stored)
