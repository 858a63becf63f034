"""Source divergence against plain loops, on random and awkward documents."""

import random
import re
from collections import Counter, defaultdict

import pytest

from evigrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
FIELDS = "doc_id long, lang string, source string, text string"


def want(rows):
    docs = [(r[1] or "", r[2] or "", TERM.findall((r[3] or "").translate(LOWER))) for r in rows]
    in_docs = defaultdict(Counter)
    for lang, _, t in docs:
        in_docs[lang].update(set(t))
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in in_docs.items()}
    count, whole, groups = defaultdict(Counter), defaultdict(Counter), {(x, s) for x, s, _ in docs}
    for lang, s, ts in docs:
        own = [t for t in ts if t in kept[lang]]
        count[lang, s].update(own)
        whole[lang].update(own)
    share = lambda c, lang, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // q
    for lang, s in groups:
        own = {t: share(count[lang, s], lang, t) for t in kept[lang]}
        pairs = [(sum(f(own[t], share(count[lang, o], lang, t)) for t in kept[lang]), o) for x, o in groups if x == lang and o != s]
        terms = [(f(own[t], q), t) for t in kept[lang] if count[lang, s][t] and own[t] > (q := share(whole[lang], lang, t))]
        for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                yield lang, s, part, item, value, rank


def random_docs(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Re", "é", "中", "x", "zz") for b in ("", "a", "Bc", "ß", "😀", "É")]
    for i in range(n):
        words = [rnd.choice(vocabulary[: rnd.choice([4, 30])]) + rnd.choice([" ", "  ", "-", "1", ", ", "\n", "' "]) for _ in range(rnd.randint(0, 40))]
        yield i, rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "a", "a", "b", "c", None, "ü"]), rnd.choice(["", None, *["".join(words)] * 8])


@pytest.mark.parametrize("tile", [1024, 2])
def test_against_plain_loops(spark, tile, monkeypatch):
    """Also in blocks of a few texts and squares of two sources."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", 1 << (22 if tile > 2 else 9))
    rows = list(random_docs(6, 300))
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, FIELDS).repartition(3)).collect()}
    assert got == set(want(rows))


def test_awkward_documents(spark):
    """No kept term, one source only, repeated rows, a long text, a hot source, more than 200 terms of one value."""
    rows = [(1, "a", "x", "one two"), (2, "a", "y", ""), (3, "b", "x", "t t t"), (3, "b", "x", "t t t"), (4, "b", "x", "t")]
    rows += [(9, "c", "x", " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(300)))] * 4 + [(10, "c", "y", "aaq " * 300_000)]
    got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS term", "2 AS block", "map(1, 2) AS m")).collect()]
    assert len(got) == len(set(got)) and set(got) == set(want(rows))
    assert max(r[5] for r in got) == 200
    assert divergence.audit(spark.createDataFrame([], FIELDS)).count() == 0


def test_invalid_utf8_is_kept_apart(spark):
    df = spark.createDataFrame([(i, b"abc \xff\xfe x") for i in range(3)], "doc_id int, raw binary").selectExpr("doc_id", "'l' AS lang", "'s' AS source", "CAST(raw AS STRING) AS text")
    assert divergence.postings(df).count() == 3
