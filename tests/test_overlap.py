"""Overlap, containment and correlation with entities that very many share, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evigrid.operators import correlate, heavy, identity


def sets(seed, owners, hot):
    """Each owner has some of ``hot`` entities and a few of 200 others."""
    rnd = random.Random(seed)
    for i in range(owners):
        own = {f"hot{h}" for h in range(hot) if rnd.random() < 0.7} | {f"e{rnd.randrange(200)}" for _ in range(rnd.choice([0, 0, 1, 3, 6]))}
        yield from ((i, e) for e in own)


def grouped(rows):
    out = defaultdict(set)
    for i, e in rows:
        out[i].add(e)
    return out


@pytest.mark.parametrize("hot", [0, 1, 4, 70])
def test_overlap_and_containment(spark, hot):
    links, wanted = list(sets(1, 150, hot)), list(sets(2, 120, hot))
    links += links[:20] + [(1000 + k, "e7") for k in range(3)] + [(2000, "hot0"), (2001, "hot0"), (2001, "hot1")]
    a = spark.createDataFrame(links, "identity_id long, entity_id string").repartition(3)
    b = spark.createDataFrame(wanted, "candidate long, entity_id string").repartition(3)
    stored, asked = grouped(links), grouped(wanted)
    best, inside = set(), set()
    for c, own in asked.items():
        tried = [(-len(own & s), -len(own & s) / len(s), i) for i, s in stored.items() if 2 * len(own & s) >= len(s) or len(own & s) >= 2]
        best |= {(c, i, -m, -s) for m, s, i in sorted(tried)[:1]}
        inside |= {(c, i) for i in sorted(i for i, s in stored.items() if s <= own)[:1]}
    assert {tuple(r) for r in identity.best_overlap(b, a).collect()} == best
    assert {tuple(r) for r in identity.contained_in(a, b).collect()} == inside and (inside or hot > 4)


def test_a_hot_entity_makes_no_pairs(spark):
    """All have one entity: the pairs that come of it are those of kinds of sets, not of sets."""
    n = 2000
    a = spark.range(n).selectExpr("id AS identity_id", "explode(array('everyone', concat('own', id))) AS entity_id")
    b = a.withColumnRenamed("identity_id", "candidate")
    links, wanted = identity._marked(a, b)
    assert links.where("hot").count() == n and links.where("hot").select("entity_id", "bits").distinct().count() == 1
    assert wanted.where("NOT hot").join(links.where("NOT hot"), "entity_id").count() == n
    assert {tuple(r) for r in identity.best_overlap(b, a).collect()} == {(i, i, 2, 1.0) for i in range(n)}


def test_frequent_values(spark):
    rows = [("hot",)] * 3000 + [(f"v{k}",) for k in range(20_000)] + [("warm",)] * 500
    df = spark.createDataFrame(rows, "v string").repartition(5)
    top = dict(heavy.frequent(df, F.col("v"), 16).join(df.select("v", F.xxhash64("v").alias("key")).distinct(), "key").select("v", "n").collect())
    assert top["hot"] >= 3000 and "warm" in top and len(top) <= 16


def test_pairs_of_a_hot_value_are_dealt_over_a_grid(spark):
    """A value that a tenth of all have: the same pairs, and no task joins more than a few cells of them."""
    m, n, cell = 900, 700, 50
    left = spark.range(9 * m).select((F.col("id") % 97).alias("x"), F.col("id").alias("a"), F.when(F.col("id") < m, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("k"))
    right = spark.range(9 * n).select(F.col("id").alias("b"), F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("k"))
    got = heavy.grid_join(left.unionByName(left.limit(3)), right, ["k"], cell)
    assert Counter(map(tuple, got.select("x", "a", "b", "k").collect())) == Counter(map(tuple, left.unionByName(left.limit(3)).join(right, "k").select("x", "a", "b", "k").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sizes = heavy.grid_join(left, right, ["k"], cell).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for c in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{c}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in sizes) > m * n and max(r["count"] for r in sizes) < m * n / 6


def test_scores_do_not_depend_on_the_grid(spark, monkeypatch):
    rnd = random.Random(3)
    fields = "identity string, type string, value string, evidence_id string"
    rows = [(f"{k % 2}{rnd.randrange(30)}", rnd.choice(["email", "domain", "city"]), rnd.choice(["Hot", f"v{rnd.randrange(40)}"]), str(rnd.randrange(3))) for k in range(400)]
    d, k = (spark.createDataFrame([r for r in rows if r[0][0] == s], fields) for s in "01")
    run = lambda: {tuple(r) for r in correlate.scores(correlate.matches(d, k, correlate.signals(spark))).collect()}
    one = run()
    monkeypatch.setattr(heavy.grid_join, "__defaults__", (7,))
    assert run() == one and len(one) > 300


@pytest.mark.parametrize("size", [heavy.MATCHES, 50])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_pairs_of_cells_are_those_of_matches(spark, monkeypatch, size, kind):
    """Values of very many and of few owners, in one cell's parts or many cells: the scores of all matches."""
    monkeypatch.setattr(heavy, "MATCHES", size)
    rnd = random.Random(5)
    fields = f"identity {kind}, type string, value string, evidence_id string"
    who = lambda: rnd.randrange(40) if kind == "long" else f"u{rnd.randrange(40)}"
    value = lambda: rnd.choice(["Hot", "hot ", f"v{rnd.randrange(9)}", f"x{rnd.randrange(900)}", None])
    some = lambda: [(None if k == 7 else who(), rnd.choice(["email", "domain", "City", "none"]), value(), rnd.choice(["1", "2", None])) for k in range(300)]
    d, k = (spark.createDataFrame(some(), fields) for _ in range(2))
    d, table = d.withColumn("listed", F.col("value") == "v3"), correlate.signals(spark)
    d = d.withColumn("listed", F.coalesce("listed", F.lit(False)))
    found = correlate.matches(d, k, table)
    want = correlate.explained(correlate.scores(found), found).drop("matched", "evidence")
    got = correlate.pair_scores(d, k, table, reasons=True)
    plain = lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect()}
    known_evidence = lambda df: df.where("draft IS NOT NULL")
    assert plain(known_evidence(got).drop("reasoning").withColumn("reasoning", F.lit(0))) == plain(want.withColumn("reasoning", F.lit(0))) != set()
    whole = d.where("evidence_id IS NOT NULL")
    found = correlate.matches(whole, k, table)
    assert plain(correlate.pair_scores(whole, k, table, reasons=True)) == plain(correlate.explained(correlate.scores(found), found).drop("matched", "evidence"))
    none = correlate.pair_scores(d.where("identity IS NULL"), k, table)
    assert none.count() == 0


def test_an_identity_that_never_comes_first_is_not_looked_up(spark):
    """Sets that hold a single entity of a lesser identity take no part, however many hold it."""
    links = spark.createDataFrame([(1, "a"), *((i, e) for i in range(2, 300) for e in ("a", f"b{i}")), (400, "c"), (401, "c"), (0, "a"), (0, "d")], "identity_id long, entity_id string")
    wanted = spark.createDataFrame([(5, "a"), (5, "b9"), (6, "c"), (7, "d"), (7, "a"), (8, "b9")], "candidate long, entity_id string")
    assert {tuple(r) for r in identity.contained_in(links, wanted).collect()} == {(5, 1), (6, 400), (7, 0)}


def some_sides(spark, seed, n=300, owners=40):
    rnd = random.Random(seed)
    fields = "identity long, type string, value string, evidence_id string"
    value = lambda: rnd.choice(["Hot", "hot ", "v1", f"v{rnd.randrange(9)}", f"x{rnd.randrange(300)}", None])
    rows = lambda: [(rnd.randrange(owners), rnd.choice(["email", "username", "domain", "City", "none"]), value(), rnd.choice("123")) for _ in range(n)]
    d, k = (spark.createDataFrame(rows(), fields) for _ in range(2))
    return d.withColumn("listed", F.coalesce(F.col("value") == "v3", F.lit(False))), k


def test_sums_of_bitmaps_are_a_product_of_matrices(monkeypatch):
    import numpy as np

    from evigrid.operators import bitmaps

    monkeypatch.setattr(bitmaps, "WIDE", 128)
    rnd = np.random.default_rng(1)
    key, owner, a, of = rnd.integers(0, 50, 3000), rnd.integers(0, 300, 3000), rnd.integers(0, 64, 900), rnd.integers(0, 50, 900)
    have, want = np.zeros((51, 300), int), np.zeros((64, 51), int)
    have[key, owner] = 1
    np.add.at(want, (a, of), 1)
    got = []
    for part, bits in bitmaps.holders(key, owner, 50, np.arange(300)):
        total = bitmaps.Sum(64, bits.shape[1])
        total.rows(bitmaps.Segments(np.zeros(900, int), a, of, 64), bits)
        got.append(bitmaps.numbers(total.planes, total.shape)[:, : len(part)])
    assert (np.hstack(got) == want @ have).all() and len(got) == 3


@pytest.mark.parametrize("dense", [0.0, float("inf")])
def test_pairs_are_the_same_by_bitmaps_and_by_matches(spark, monkeypatch, dense):
    """All that a cell can give of a pair, where its owners share much and where they do not."""
    monkeypatch.setattr(heavy, "DENSE", dense)
    d, k = some_sides(spark, 8)
    found = correlate.matches(d, k, correlate.signals(spark))
    numbers = [F.regexp_extract("reasoning", p, 1).cast("long") for p in (r"from (\d+)", r"in (\d+) pieces")]
    want = correlate.explained(correlate.scores(found), found).withColumns(dict(zip(("n_signals", "n_evidence"), numbers)))
    cols = ("decisive_tier", "n_matches", "capped", "score", "on_watchlist", "n_signals", "n_evidence")
    got = correlate.pair_scores(d, k, correlate.signals(spark), only=cols)
    rows = lambda df: {tuple(r) for r in df.select("draft", "known", *cols).collect()}
    assert got.columns == ["draft", "known", *cols] and rows(got) == rows(want) != set()


@pytest.mark.parametrize("dense", [0.0, float("inf")])
def test_best_drafts_are_those_of_all_pairs(spark, monkeypatch, dense):
    """a cell gives a row for each known identity, and no pair is shuffled for the best of them."""
    monkeypatch.setattr(heavy, "DENSE", dense)
    d, k = some_sides(spark, 9)
    pairs = correlate.scores(correlate.matches(d, k, correlate.signals(spark)))
    want = pairs.groupBy("known").agg(F.count("*").alias("n_drafts"), F.max("score").alias("best"), F.max_by("draft", F.col("score") * 1e9 - F.col("draft")).alias("best_draft"))
    got = correlate.best_drafts(d, k, correlate.signals(spark))
    assert {tuple(r) for r in got.select(want.columns).collect()} == {tuple(r) for r in want.collect()} != set()


@pytest.mark.parametrize("dense", [0.0, float("inf")])
@pytest.mark.parametrize("overlap, shared", [(0.5, 2), (0.34, 4), (0.9, 100)])
def test_best_overlap_by_bitmaps_and_by_matches(spark, monkeypatch, dense, overlap, shared):
    """the same best identities, also where the most shared entities are too few and fewer fit."""
    monkeypatch.setattr(heavy, "DENSE", dense)
    links, wanted = (list(sets(seed, n, 2)) for seed, n in ((11, 130), (12, 90)))
    stored, asked = grouped(links), grouped(wanted)
    best = set()
    for c, own in asked.items():
        both = [(len(own & s), len(s), i) for i, s in stored.items()]
        fits = [(-m, -m / n, i) for m, n, i in both if m and (m / n >= overlap or m >= shared)]
        best |= {(c, i, -m, -s) for m, s, i in sorted(fits)[:1]}
    a, b = spark.createDataFrame(links, "identity_id long, entity_id string"), spark.createDataFrame(wanted, "candidate long, entity_id string")
    assert {tuple(r) for r in identity.best_overlap(b, a, overlap, shared).collect()} == best


def test_blocks_do_not_follow_the_matches(spark, monkeypatch):
    """the copies of a row that all match are those of a few blocks, however small a part of the matches is."""
    monkeypatch.setattr(heavy, "MATCHES", 10)
    copies = []
    monkeypatch.setattr(heavy.F, "sequence", lambda a, b, f=F.sequence: copies.append(b) or f(a, b))
    d, k = (spark.range(300).selectExpr("id + 1000 * %d AS identity" % s, "'email' AS type", "'hot' AS value", "1 AS evidence_id") for s in (0, 1))
    assert correlate.pair_scores(d, k, correlate.signals(spark), only=("score",)).count() == 300 * 300
    assert copies and all(int(c._jc.toString()) < 4 for c in copies)
