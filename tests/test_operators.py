"""Operators against worked examples and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import components, correlate, events, graph, identity, ingest, reads, rules


def pair(spark, draft, known):
    d = spark.createDataFrame([("d", *x) for x in draft], "identity string, type string, value string, evidence_id string")
    k = spark.createDataFrame([("g", t, v) for t, v, _ in known], "identity string, type string, value string")
    return correlate.scores(correlate.matches(d, k, correlate.signals(spark))).first()


CASES = [
    ([("email", "a@b.c", "1")], 0.90, 1), ([("email", "a", "1"), ("phone", "b", "1")], 0.90, 1), ([("email", "a", "1"), ("phone", "b", "2")], 0.99, 1), ([("username", "a", "1"), ("avatar_hash", "b", "2"), ("domain", "c", "3")], 0.75, 2),
    ([("display_name", "a", "1"), ("company", "b", "2"), ("city", "c", "3"), ("country", "d", "4"), ("language", "e", "5")], 0.45, 3), ([("email", "a", "1"), ("username", "b", "2")], 0.955, 1), ([("email", "a", "1"), ("phone", "b", "1"), ("btc", "c", "1"), ("pgp_fingerprint", "d", "1"), ("username", "e", "1")], 1.0, 1),
]


@pytest.mark.parametrize(("entities", "score", "tier"), CASES)
def test_scores(spark, entities, score, tier):
    r = pair(spark, entities, entities)
    assert (r.score, r.decisive_tier) == (pytest.approx(score, abs=1e-6), tier)


def test_values_match_without_case_and_no_match_has_no_row(spark):
    assert pair(spark, [("Email", " A@B.c", "1")], [("email", "a@b.C", "9")]).score == 0.9
    assert pair(spark, [("email", "x", "1")], [("email", "y", "1")]) is None


@pytest.mark.parametrize(("score", "tier", "listed", "kinds", "wins"), [(0.95, 1, False, {"auto_merge"}, "auto_merge"), (0.95, 2, False, set(), None), (0.5, 2, False, {"queue_review"}, "queue_review"), (0.9, 1, True, {"auto_merge", "queue_review"}, "queue_review"), (0.49, 3, None, set(), None)])
def test_rules(spark, score, tier, listed, kinds, wins):
    p = spark.createDataFrame([("d", "g", score, tier, listed, 1, 1)], "draft string, known string, score double, decisive_tier int, on_watchlist boolean, n_entities long, n_evidence long")
    got = rules.proposals(p)
    assert {r.kind for r in got.collect()} == kinds
    assert [r.kind for r in rules.resolved(got).collect()] == ([wins] if wins else [])


def test_no_overlap_promotes(spark):
    p = spark.createDataFrame([("d", "g", 0.2, 3, None, 0, 2)], "draft string, known string, score double, decisive_tier int, on_watchlist boolean, n_entities long, n_evidence long")
    assert [r.kind for r in rules.proposals(p).collect()] == ["promote"]


@pytest.mark.parametrize(("members", "confidence", "status"), [([("email", 1), ("phone", 1)], 0.9775, "confirmed"), ([("domain", 1)], 0.2, "tentative"), ([("email", 5)], 0.85, "confirmed"), ([("username", 3)], 1.0, "confirmed")])
def test_confidence(spark, members, confidence, status):
    df = spark.createDataFrame([("i", t, n) for t, n in members], "identity_id string, type string, n_sources long")
    r = identity.confidence(df).first()
    assert (r.confidence, r.status) == (pytest.approx(confidence), status)


@pytest.mark.parametrize("seed", range(2))
def test_components_of_many_edges(spark, seed):
    """Contraction gives what stars alone give: cliques, chains, hubs, repeated edges."""
    rnd = random.Random(seed)
    edges = [(rnd.randrange(k * 40, k * 40 + 25), rnd.randrange(k * 40, k * 40 + 25)) for k in range(6) for _ in range(120)]
    edges += [(i, i + 1) for i in range(500, 530)] + [(999, i) for i in range(600, 640)] + [(20 + 40 * rnd.randrange(6), 20 + 40 * rnd.randrange(6))] + [(7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in components.connected_components(df).collect()}
    assert {tuple(r) for r in components.connected_components(df, many=0).collect()} == want
    assert len({c for _, c in want}) > 3
    named, rest = components._contracted(components._descending(df.where("a <> b")), 60)
    assert 2 * named.select("component").distinct().count() <= named.count() and rest.count() < 20


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    n = 60
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(7, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_betweenness(spark):
    rnd = random.Random(4)
    edges = {(f"n{a}", f"n{b}") for a, b in ((rnd.randrange(9), rnd.randrange(9)) for _ in range(14)) if a != b}
    got = {r.node_id: r.betweenness for r in graph.betweenness(spark.createDataFrame([(1, a, b) for a, b in edges], "graph_id long, source string, target string")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0)
    for s, t in itertools.permutations(near, 2):
        paths, seen = [[s]], {s}
        while paths and paths[0][-1] != t:  # first found wins; neighbours in order
            p = paths.pop(0)
            for y in sorted(near[p[-1]]):
                if y not in seen:
                    seen.add(y)
                    paths.append([*p, y])
        for x in paths[0][1:-1] if paths else []:
            want[x] += 1
    n = len(near)
    assert got == {k: pytest.approx(v / ((n - 1) * (n - 2) / 2)) for k, v in want.items()}


def test_rate_limit(spark):
    rnd = random.Random(2)
    rows = [(c, i * 2 + c, rnd.randrange(4000)) for c in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "client long, request_id long, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.client, r.request_id) for r in reads.allowed_requests(df, 3, 300).collect()}
    want = set()
    for c in range(2):
        passed = []
        for _, rid, s in sorted((x for x in rows if x[0] == c), key=lambda x: (x[2], x[1])):
            if sum(p > s - 300 for p in passed) < 3:
                passed.append(s)
                want.add((c, rid))
    assert got == want


def test_ingestion_is_idempotent(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "p", 2), ("y", "p", 3)], "execution_id string, plugin_id string, evidence_id long")
    once = ingest.new_only(df)
    assert sorted(r.evidence_id for r in once.collect()) == [1, 3]
    assert ingest.new_only(df, once).count() == 0


def test_review_needs_approval_before_execution(spark):
    df = spark.createDataFrame([("a", 1, "execute"), ("a", 2, "approve"), ("b", 1, "approve"), ("b", 2, "execute"), ("c", 1, "reject"), ("c", 2, "approve")], "decision_id string, at long, action string")
    assert {r.decision_id: r.status for r in events.review_states(df).collect()} == {"a": "approved", "b": "executed", "c": "rejected"}


def test_streamed_batches_carry_state(spark, tmp_path):
    from evigrid.streaming import monitors

    schema = "monitor_id long, at timestamp_ntz, seq long, fingerprint string, summary string"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, prints in enumerate((["a", "a"], ["b", "a"], ["a", "c"])):
        rows = [(1, f"2024-01-0{k + 1} 0{i}:00:00", i, f, None) for i, f in enumerate(prints)]
        spark.createDataFrame(rows, "monitor_id long, at string, seq long, fingerprint string, summary string").withColumn("at", F.col("at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        q = monitors.changes(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(out).orderBy("change_count").collect()
    assert [(r.old, r.new, r.change_count) for r in got] == [("a", "b", 1), ("b", "a", 2), ("a", "c", 3)]


def test_store_takes_each_execution_once(spark, tmp_path):
    from evigrid.streaming import monitors

    schema = "execution_id string, plugin_id string, v long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([("x", "p", k), (f"y{k}", "p", k)], schema).coalesce(1).write.mode("append").parquet(source)
        monitors.into_store(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.execution_id for r in spark.read.parquet(out).collect()) == ["x", "y0", "y1"]


def test_sources_and_exports(spark, tmp_path):
    import json

    from evigrid.sources import exports, files

    (tmp_path / "g.json").write_text(json.dumps({"plugin_id": "p", "fixture_name": "f", "input": "i", "legacy_result": {"success": True, "data": "{}", "error": None}, "expected_canonical": "{}", "schema_version": 1}))
    assert files.golden(spark, str(tmp_path / "g.json")).count() == 1
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="missing fields"):
        files.golden(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 /Title (Hello) /Author (Me)")
    assert files.images(spark, str(tmp_path / "x.pdf")).first().kind == "pdf"
    assert files.pdf_fields(spark.read.format("binaryFile").load(str(tmp_path / "x.pdf"))).first()[1:3] == ("Hello", "Me")
    import uuid

    assert spark.range(1).select(exports.uuid5(F.lit("a-b")).alias("u")).first().u == str(uuid.uuid5(uuid.NAMESPACE_URL, "a-b"))
    rows = [(1, "shodan", True, "2024-01-01", '{"p":[1]}'), (1, "shodan", True, "2024-01-02", '{"p":[2]}'), (1, "dns", True, "2024-01-01", '{"a":"x"}'), (1, "bad", False, "2024-01-01", None)]
    df = spark.createDataFrame(rows, "investigation_id long, plugin_name string, success boolean, collected_at string, raw string")
    got = files.combined(df).select(F.to_json("data").alias("j")).first().j
    assert json.loads(got) == {"dns": {"a": "x"}, "shodan": {"p": [2]}}
