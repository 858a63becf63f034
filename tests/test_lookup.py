"""The trigram index against plain search, levels of dependencies against a walk."""

import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import levels, trigrams


def test_search_by_trigrams(spark):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "ßtraße", "é😀x", "a", "", "aaaa", "zz top", "100%_"]
    texts = [(i, None if i % 29 == 0 else "".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 8)))) for i in range(200)]
    terms = [(k, t) for k, t in enumerate(["alpha", "ALPHA beta", "aaa", "aaaaa", "a", "é😀", "😀x", "top zz", "%_", "", None, "nowhere", "betaGam", "ß", "zz"])]
    a = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    b = spark.createDataFrame(terms, "term_id long, term string")
    index = trigrams.index(a, "doc", "body")
    got = sorted(map(tuple, trigrams.search(a, "doc", "body", index, b).collect()))
    assert got == sorted((k, i) for k, t in terms for i, x in texts if t and x is not None and t.lower() in x.lower())
    rare = b.where("term IN ('ALPHA beta', 'nowhere', 'top zz')")
    assert trigrams.candidates(index, rare.select("term_id", F.lower("term").alias("term"))).count() < 60  # of 3 x 193 texts


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(1, None), (None, 2), (3, 3)]
    whole = [(a, b) for a, b in edges if a is not None and b is not None]
    nodes = {x for e in whole for x in e} | {777}
    level, changed = dict.fromkeys(nodes - {a for a, _ in whole}, 0), True
    while changed:
        changed = False
        for n in nodes - level.keys():
            needs = [b for a, b in whole if a == n]
            if all(b in level for b in needs):
                level[n], changed = 1 + max(level[b] for b in needs), True
    got = levels.levels(spark.createDataFrame(edges, "node long, needs long"), spark.createDataFrame([(777,), (None,)], "node long")).collect()
    assert {r.node: r.level for r in got} == {n: level.get(n) for n in nodes} and len(got) == len(nodes)


def test_search_by_characters_of_either_case(spark):
    """Case goes character by character: a capital of two characters or a last sigma hides no text."""
    texts = [(1, "chver ßkeit de"), (2, "ΟΔΟΣ"), (3, "οδοσα"), (4, "İstanbul"), (5, "strasse")]
    a, up = spark.createDataFrame(texts, "doc long, body string"), trigrams.upper_each(F.col("t"))
    b = spark.createDataFrame([(1, "ver ßkei"), (2, "οδοσ"), (3, "istan"), (4, "ß")], "term_id long, t string").select("term_id", up.alias("term"))
    got = trigrams.search(a, "doc", "body", trigrams.index(a, "doc", "body"), b)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (2, 3), (3, 4), (4, 1)]


def test_levels_send_nothing_to_the_driver(spark, monkeypatch):
    plans, written = [], levels.written

    def kept(df, name):
        out = written(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(levels, "written", kept)
    edges = spark.createDataFrame([(i, i // 3) for i in range(3, 200)], "node long, needs long")
    assert levels.levels(edges).where("level IS NULL").count() == 0
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
