"""Awkward inputs for every corpus operator and stage: hashes that collide, tasks with hardly a byte, long texts, clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import bag, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from evigrid.llm import bytedup, decontaminate, html, nearcopies, quality, shards, simhash, substrings, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


def morse(a, b, n=2048):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def _bytes(rows):
    want = collections.Counter()
    for r, u, m in brute_spans(rows, lambda t: (t or "").encode(), 50):
        runs = sum(m[i] and (i == 0 or not m[i - 1]) for i in range(len(m)))
        want[(r[0], len(u), sum(m), runs, sha(bytes(b for b, x in zip(u, m) if not x)))] += 1
    return want


def _words(rows):
    want = collections.Counter()
    for r, u, m in brute_spans(rows, lambda t: (t or "").encode().split(), 13):
        want[(r[0], len(u), sum(m), sha(b" ".join(w for w, x in zip(u, m) if not x)))] += 1
    return want


def _tokens(rows):
    library = Tokenizer.from_file(PATH)
    count, ids = collections.Counter(), collections.Counter()
    for r in rows:
        e = library.encode(r[1] or "", add_special_tokens=False).ids
        count[(r[0], len((r[1] or "").encode()), len(e), len(e) > 1024)] += 1
        ids[(r[0], len(e), sha(np.array(e, "<u4").tobytes()), sha(library.decode(e, skip_special_tokens=False).encode()))] += 1
    return count, ids


BYTES, WORDS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ("doc_id", "n_words", "n_removed", "kept_sha256")
COUNTS, IDS = ("doc_id", "n_bytes", "n_tokens", "over_limit"), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_words_whose_hashes_collide(spark):
    """Thue-Morse words of 2,048 letters and their complements have one polynomial hash modulo 2^64."""
    a, b = morse("e", "o"), morse("o", "e")
    rows = [(1, a), (2, b), (3, f"x {a} {b}"), (4, f"x {b} {a}"), (5, " ".join([a] * 13)), (6, " ".join([b] * 13)), (7, " ".join([b] * 13) + " y"), (8, f"{b}. {a}.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bag(bytedup.deduplicated(docs), *BYTES) == _bytes(rows)
    assert bag(substrings.deduplicated(docs), *WORDS) == _words(rows)
    count, ids = _tokens(rows)
    assert bag(tokens.token_counts(docs, PATH), *COUNTS) == count
    assert bag(tokens.round_trips(docs, PATH), *IDS) == ids
    run = lambda w: " ".join([w] * 8)
    pages = [(i, f"http://h.x/{i}", f"<article><p>{run(a if i < 3 else b)}</p><p>{' '.join(f'own{i}w{j}' for j in range(20))}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(run(a) not in got[i] for i in range(3)) and all(run(b) in got[i] for i in (3, 4))


@pytest.mark.parametrize("rows", [[(1, None)], [(1, "ab"), (2, "")], [(1, None), (2, None), (None, None)], [(1, "x" * 49), (2, "x" * 49), (3, None), (4, "x" * 50), (5, "x" * 50)]])
def test_hardly_a_byte_in_a_task(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows) + 2)
    assert bag(bytedup.deduplicated(docs), *BYTES) == _bytes(rows)
    assert bag(substrings.deduplicated(docs), *WORDS) == _words(rows)
    count, ids = _tokens(rows)
    assert bag(tokens.token_counts(docs, PATH), *COUNTS) == count
    assert bag(tokens.round_trips(docs, PATH), *IDS) == ids
    assert shards.sharded(docs).count() == simhash.near_duplicates(docs).count() == len(rows)


def _long(rnd, words, size):
    out, n = [], 0
    while n < size:
        w = rnd.choice(words)
        out.append(w)
        n += len(w) + 1
    return " ".join(out)


def test_texts_longer_than_a_block(spark):
    """Texts over 4 MiB (bytes: 1 MiB) are whole: what is found in their last words is found."""
    rnd = random.Random(5)
    words = [f"w{i:x}" for i in range(50_000)] + ["straße", "don't", "=====", "中文中文"]
    end = " ".join(f"end{i}" for i in range(40))
    rows = [(1, end), (2, _long(rnd, words, 4_600_000) + " " + end), (3, _long(rnd, words, 3000)), (4, "a" * 60_000 + " " + end)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert bag(substrings.deduplicated(docs), *WORDS) == _words(rows)
    count, ids = _tokens(rows)
    assert bag(tokens.token_counts(docs, PATH), *COUNTS) == count
    assert bag(tokens.round_trips(docs, PATH), *IDS) == ids
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, spark.createDataFrame([(1, end)], "item_id long, text string")).collect()}
    assert hit == {1: 40, 2: 40, 3: 0, 4: 40}
    judged = quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int"), stratum="doc_id")
    assert {r.row.doc_id: r.n_words for r in judged.collect()} == {i: len(t.split()) for i, t in rows}
    short = [(i, t[-1_200_000:]) for i, t in rows]
    assert bag(bytedup.deduplicated(spark.createDataFrame(short, "doc_id long, text string")), *BYTES) == _bytes(short)
    page = [(1, "http://a.x/", f"<nav>m</nav><article><p>{rows[1][1]}</p></article>")]
    assert html.main_texts(spark.createDataFrame(page, "page_id long, url string, html string")).first().text == rows[1][1]


def test_large_benchmark_is_searched_a_part_at_a_time(spark):
    """Tables stay under the bound on built bytes; one text under many ids and one long item are dealt too."""
    rnd = random.Random(6)
    words = [f"v{i:x}" for i in range(3000)]
    items = [(i, _long(rnd, words, 300)) for i in range(300)] + [(1000 + i, _long(random.Random(1), words, 200)) for i in range(400)] + [(5000, _long(rnd, words, 200_000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = list(decontaminate._parts(bench, 10, 1 << 20))
    assert len(parts) > 2
    for part in parts:
        assert sum(t.nbytes for t in decontaminate.build(part)) <= 1 << 20
    docs = spark.createDataFrame([(1, items[7][1]), (2, items[500][1]), (3, "x " + items[-1][1][-90:]), (4, "nothing here")], "doc_id long, text string")
    one, many = (decontaminate.contamination(docs, bench, most_bytes=m) for m in (64 << 20, 1 << 20))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(one, *cols) == bag(many, *cols)
    assert {r.doc_id: r.n_items for r in one.collect()} == {1: 1, 2: 400, 3: 1, 4: 0}


CLASH = "doc_id long, text string, lang string, source string, n_chars int, stratum string, kept boolean, n_words string, row int, _d int, _s int, _words int, fall int, level int, starts int, tag int, cut int, c0 int, ids int, c int, s int, k int"


def _clash():
    rnd = random.Random(2)
    say = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    copied, passage = say(60), say(30)
    texts = [None, "", "few words", copied, copied, copied + " z", say(40) + " " + passage, say(50) + " " + passage, say(3000), "bench " + " ".join(f"q{i}" for i in range(12)) + " " + say(30)]
    rows = [(i + 1, t, "en", "s", None if t is None else len(t), "S", False, "N", *range(14)) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[6], (None, say(40), None, None, 1, None, None, None, *[None] * 14)]


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    rows = _clash()
    docs = spark.createDataFrame(rows, CLASH)
    spark.createDataFrame([(1, " ".join(f"Q{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rest = {r[0]: tuple(r[5:]) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0), docs.union(docs)):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(tuple(r[5:]) == rest[r.doc_id] for r in got), name
            assert bool(got) == (given.limit(1).count() > 0), name
    encoded = corpus_pipeline.bpe_encoding(spark, docs, str(tmp_path))
    assert encoded.count() == len(rows) and corpus_pipeline.bpe_encoding(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {10}
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {4, 5, 6, 7, 8, 9, 10, None}


def test_stories_inside_odd_class_names_stay(spark):
    story = "<p>The story goes on and on.</p>"
    pages = [
        f'<div class="post with-sidebar">{story}</div>',
        f'<div class="article-notice"><article>{story}</article></div>',
        f'<div class="single-comment-story"><article>{story}</article></div>',
        f'<div class="notice"><article>{story}</article></div>',
        f'<article>{story}<div class="comment-list"><p>First!</p></div><p class="share-bar">Share</p></article><div class="site-footer">Foot</div>',
        f'<main>{story}</main><div class="comments"><article>A reader says so.</article></div>',
        f'<div>{story}</div><div class="comments"><article>Me too.</article></div>',
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.x/", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    assert {r.text for r in html.main_texts(df).collect()} == {"The story goes on and on."}


def brute_runs(pages, run, least):
    """Text of each page without the tokens that runs on ``least`` distinct pages of a host cover."""
    streams = [(u.split("/")[2], html.stream(h)) for _, u, h in pages]
    where = collections.defaultdict(set)
    for host, t in set(streams):
        w = t.split()
        for i in range(len(w) - run + 1):
            where[(host, *w[i : i + run])].add(t)
    out = []
    for (i, _, _), (host, t) in zip(pages, streams):
        w = t.split()
        places = [j for j in range(len(w) - run + 1) if len(where[(host, *w[j : j + run])]) >= least]
        mask = [False] * len(w)
        for j in places:
            mask[j : j + run] = [True] * run
        if 5 * sum(mask) >= 4 * len(w):
            mask = [False] * len(w)
        at, kept = 0, []
        for line in t.split("\n"):
            ws = line.split()
            gone = mask[at : at + len(ws)]
            at += len(ws)
            if not all(gone):
                marks = "".join("x" if g else "." for g in gone)
                marks = re.sub("x+", lambda m: m[0] if len(m[0]) >= run else "." * len(m[0]), marks)
                kept.append(" ".join(x for x, m in zip(ws, marks) if m == "."))
        out.append((i, "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("bits", [30, 3])
def test_repeated_runs_of_a_host(spark, bits):
    rnd = random.Random(12)
    say = lambda n: " ".join(f"t{rnd.randint(0, 900)}" for _ in range(n))
    lines, block = [say(n) for n in (7, 8, 9, 30, 12)], say(25)
    pages = []
    for i in range(60):
        parts = [say(rnd.randint(5, 60)) for _ in range(4)] + [rnd.choice(lines) for _ in range(2)]
        if i % 4 == 0:
            parts += [block[: len(block) // 2].strip(), block[len(block) // 2 :].strip()]  # a run across blocks
        rnd.shuffle(parts)
        body = "".join(f"<p>{p}</p>" for p in parts)
        pages.append((i, f"http://host{i % 3}.x/{i}", f"<article>{body}</article>" if i % 2 else f"<body><div>{body}</div></body>"))
    copy = say(50)
    pages += [(100 + i, f"http://host0.x/c{i}", f"<article><p>{copy}</p><p>tail {i}</p></article>") for i in range(4)]  # copies stay whole
    pages += [pages[0], (200, "http://host1.x/dup", pages[4][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    want = brute_runs(pages, html.RUN, html.PAGES)
    assert bag(html.main_texts(df, bits=bits), "page_id", "text") == want
    assert any(t != html.stream(h) for (_, t), (_, _, h) in zip(want, pages))


def test_ids_of_other_types(spark):
    """Text, decimal and null ids keep their order and their type."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [("b", "x " + words), ("a10", words), ("a9", words + " y"), (None, words), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    numbers = {"a10": 1, "a9": 2, "b": 3, "c": 4, None: None}
    plain = [(numbers[i], t) for i, t in rows]
    back = {v: k for k, v in numbers.items()}
    assert bag(bytedup.deduplicated(docs), *BYTES) == collections.Counter((back[k[0]], *k[1:]) for k in _bytes(plain).elements())
    assert bag(substrings.deduplicated(docs), *WORDS) == collections.Counter((back[k[0]], *k[1:]) for k in _words(plain).elements())
    kept = substrings.without_repeats(docs.selectExpr("CAST(NULL AS DECIMAL(5,1)) AS d", "doc_id", "text", "map(1, 2) AS _n")).collect()
    assert {r.doc_id: r.text for r in kept} == {"a10": words, "b": "x", "a9": "y", None: words, "c": None} and kept[0]._n == {1: 2}


def test_columns_without_order(spark):
    rows = [(2, "one two three four five six", {"k": 1}), (1, "one two three four five six", {"k": 2}), (3, None, None), (3, "", {"a": 1}), (9, "quite another text it is", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    got = {(r.doc_id, r.text or "", tuple((r.m or {}).items())) for r in nearcopies.one_of_each(docs).collect()}
    assert (1, "one two three four five six", (("k", 2),)) in got and (9, "quite another text it is", ()) in got and len(got) == 3


def test_bytes_that_are_no_text(spark):
    end = b" ".join(b"v%d\xff" % i for i in range(20))
    df = spark.createDataFrame([(1, end), (2, b"\xfe " + end)], "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS STRING) AS text")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.deduplicated(df).drop("kept_text").collect()}
    assert got == {1: (0, sha(end)), 2: (20, sha(b"\xfe"))}
    assert {r.doc_id: bytes(r.b) for r in substrings.without_repeats(df).selectExpr("doc_id", "CAST(text AS BINARY) AS b").collect()} == {1: end, 2: b"\xfe"}


@pytest.mark.parametrize(("page", "text"), [
    ('<form id="aspnetForm"><div>menu</div><main><h1>T</h1><p>story here</p><div class="newsletter">join</div><form>x</form></main></form>', "T\nstory here"),
    ("<form><article><p>tale</p></article></form>", "tale"),
    ("<dialog><article><p>in dialog</p></article></dialog>", "in dialog"),
    ("<div><h1>T</h1><p>story outside</p></div><article><p>teaser</p></article>", "T\nstory outside\nteaser"),
    ('<div class="comments"><article><p>reader says</p></article></div><article><p>story</p></article>', "story"),
    ('<article><p>a</p><form>sign up</form><p>b</p><div class="comments"><article>no</article></div></article>', "a\nb"),
    ("<article><header><h1>x</h1></header><p>a <math><mi>y</mi></math></p></article>", "x\na y"),
    ("<aside><article>no</article></aside><p>yes</p>", "yes"),
    ('<article class="notice"><p>all there is</p></article>', "all there is"),
    ("<form><p>only a form</p></form><p>text</p>", "text"),
])
def test_articles_wherever_they_stand(page, text):
    assert html.stream(page) == text
