"""Each corpus operator against a brute-force version, over a fixture with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from evigrid.llm import bytedup, decontaminate, html, ordinal, quality, shards, simhash, spans, substrings, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Columns whose names the operators use themselves come along as clutter.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag int, fp long, key string, kept boolean, n_words long, starts binary, size long, item long"


def _rows():
    rnd = random.Random(7)
    vocab = ["the", "of", "ération", "straße", "token", "a", "I'll", "don't", "x1", "42", "—", "end.", "Quick", "中文", "😀"]
    say = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", "", "s", "ed"]) for _ in range(n))
    passage, near = say(60), say(120).split()
    texts = [None, "", " \n\t ", "one", "two words", "a\x1cb \x85 c", "<|endoftext|> x<|endoftext|>", "=" * 300, passage, passage, passage]
    texts += [say(10) + "\n" + passage + " " + say(9) for _ in range(6)]
    for k in range(8):
        w = list(near)
        w[k * 3] = f"edit{k}"
        texts.append(" ".join(w))
    texts += ["line one here\nline one here\n\n" + say(30), "spam " * 40, "a b c d e f g h " * 6, say(6000)]
    texts += [say(rnd.randint(1, 80)) for _ in range(25)]
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], "s", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (rows[12][0], say(20) + passage, "en", "s", 1), (None, passage, "en", "s", 1), (None, None, None, None, None)]
    return [r + (1, 2, "k", True, 3, b"\1", 4, 5) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_sharding(docs, rows, none):
    got = shards.sharded(docs, shards=4).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    by, slots = collections.defaultdict(set), collections.defaultdict(list)
    of = {}
    for r in got:
        slots[r.shard].append(r.slot)
        of[(r.doc_id, r.size, r.text_crc32)] = r.shard
    for r in rows:
        by[r[1]].add(of[(r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode()))])
    assert all(len(s) == 1 for s in by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert shards.sharded(none).count() == 0


def test_differencing_balances():
    rnd = random.Random(1)
    for n in (0, 1, 3, 40, 500):
        sizes = [rnd.randint(1, 1000) for _ in range(n)]
        got = shards.differencing(sizes, 8)
        loads = np.bincount(got, sizes, 8) if n else np.zeros(8)
        assert len(got) == n and loads.sum() == sum(sizes)
        if n >= 40:
            greedy = [0] * 8  # largest first, to the lightest shard
            for x in sorted(sizes, reverse=True):
                greedy[greedy.index(min(greedy))] += x
            assert loads.max() - loads.min() <= max(greedy) - min(greedy)
    assert max(np.bincount(shards.differencing([900] + [10] * 90, 4), [900] + [10] * 90, 4)) == 900


def test_differencing_against_a_naive_version():
    """Partial partitions as plain lists of item lists; the two with the largest spread are combined, first met first."""

    def naive(sizes, shards):
        parts = [[[i]] + [[] for _ in range(shards - 1)] for i in range(len(sizes))]
        weigh = lambda items: sum(sizes[i] for i in items)
        made, age = len(sizes), dict(enumerate(range(len(sizes))))
        live = list(range(len(sizes)))
        while len(live) > 1:
            live.sort(key=lambda k: (weigh(parts[k][-1]) - weigh(parts[k][0]), age[k]))
            a, b = parts[live[0]], parts[live[1]]
            both = sorted((x + y for x, y in zip(a, reversed(b))), key=lambda p: -weigh(p))
            parts.append(both)
            age[len(parts) - 1] = made
            made += 1
            live = [*live[2:], len(parts) - 1]
        return sorted(weigh(p) for p in parts[live[0]])

    rnd = random.Random(21)
    for n, shards in ((1, 3), (5, 2), (17, 4), (60, 7)):
        sizes = [rnd.randint(1, 10**6) for _ in range(n)]
        got = shards_of(sizes, shards)
        assert sorted(np.bincount(got, sizes, shards).astype(int).tolist()) == naive(sizes, shards)


def shards_of(sizes, n):
    return shards.differencing(sizes, n)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = collections.Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            cover |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels)
    assert got.columns == ["row", *quality.COUNTS, "base_failed", "kept"] and got.select("row.*").columns == docs.columns
    for r in got.collect():
        n = brute_counts(r.row.text)
        assert tuple(r[c] for c in quality.COUNTS) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert r.kept == (not r.base_failed)  # far too few labels for any level
    assert quality.judged(none, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).count() == len(rows)


def test_quality_bound_holds_for_all_rules_together(spark):
    """The strictest level whose union of rules is shown to reject at most the risk, by the exact bound."""
    from math import comb

    from pyspark.sql import functions as F

    rnd, n = random.Random(11), 900
    facts = []
    for i in range(n):
        words = 100
        facts.append((i, "en" if i % 3 else "de", words, int(words * rnd.gauss(5, 0.4)), rnd.choice([0] * 30 + [1, 5]), rnd.choice([0] * 40 + [1, 2]), 0, rnd.choice([0] * 9 + [1, 2])))
    counted = spark.createDataFrame(facts, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_echo_words long").withColumn("fall", quality.fall())
    cuts = {r: quality.cutoffs(r) for r in quality.RULES}
    assert all(c == sorted(c, reverse=True) for c in cuts.values())

    def fall(f):
        ratios = {"symbols": f[4] / f[3], "dup_lines": f[5] / f[2], "echoes": f[7] / f[2], "word_length": f[3] / f[2]}
        return next((i for i in range(quality.LEVELS) if any(ratios[r] > cuts[r][i] for r in cuts)), quality.LEVELS)

    assert {r.doc_id: r.fall for r in counted.collect()} == {f[0]: fall(f) for f in facts}
    risk, delta = 0.05, 0.1
    want = {}
    for lang in ("de", "en"):
        falls = [fall(f) for f in facts if f[1] == lang]
        tail = lambda k, m: sum(comb(m, i) * risk**i * (1 - risk) ** (m - i) for i in range(k + 1))
        for level in range(quality.LEVELS):
            k = sum(x <= level for x in falls)
            if tail(k, len(falls)) > delta / 2:
                break
            assert k <= risk * len(falls)
            want[lang] = level
    labels = counted.selectExpr("doc_id", "1 AS quality")
    assert {r.stratum: r.level for r in quality.allowed(counted, labels, risk, delta).collect()} == want
    few = quality.allowed(counted.where(F.col("doc_id") < 60), labels, risk, delta)
    assert few.count() == 0


def brute_spans(rows, unit, width):
    """(units, mask) of each row; unit: text -> list of units."""
    first = {}
    for r in rows:
        if r[0] is not None:
            u = unit(r[1])
            for i in range(len(u) - width + 1):
                k = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        u = unit(r[1])
        m = [False] * len(u)
        for i in range(len(u) - width + 1 if r[0] is not None else 0):
            k = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
            if first[k] < r[0]:
                m[i : i + width] = [True] * width
        out.append((r, u, m))
    return out


@pytest.mark.parametrize("bits", [spans.FILTER_BITS, 4])
def test_byte_dedup(docs, rows, none, bits):
    want = collections.Counter()
    for r, u, m in brute_spans(rows, lambda t: (t or "").encode(), 50):
        runs = sum(m[i] and (i == 0 or not m[i - 1]) for i in range(len(m)))
        want[(r[0], len(u), sum(m), runs, hashlib.sha256(bytes(b for b, x in zip(u, m) if not x)).hexdigest())] += 1
    assert bag(bytedup.deduplicated(docs, bits=bits), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert bytedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("bits", [spans.FILTER_BITS, 4])
def test_substring_dedup(docs, rows, none, bits):
    want = collections.Counter()
    for r, u, m in brute_spans(rows, lambda t: (t or "").encode().split(), 13):
        want[(r[0], len(u), sum(m), hashlib.sha256(b" ".join(w for w, x in zip(u, m) if not x)).hexdigest())] += 1
    assert bag(substrings.deduplicated(docs, bits=bits), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.deduplicated(none).count() == 0
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() < len(rows)


def test_cover_has_every_difference():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + k) % substrings.PERIOD in substrings.COVER and (b + k) % substrings.PERIOD in substrings.COVER for k in range(substrings.PERIOD))


def brute_fp(t):
    b = (t or "").encode().lower().split()
    if not b:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(b[i : i + 4]), 42) for i in range(max(1, len(b) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    fps = [brute_fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = collections.Counter((r[0], f"{fps[i]:016x}", least[find(i)]) for i, r in enumerate(rows))
    assert bag(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_dense_and_large_tables():
    rnd = np.random.default_rng(5)
    centre = rnd.integers(0, 1 << 63, 1, dtype=np.uint64)
    flips = np.uint64(1) << rnd.integers(0, 40, (6000, 3)).astype(np.uint64)
    fp = np.unique(centre ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    x, y = simhash._near(fp, 4)
    assert len(fp) > simhash.TABLE and len(x) < 6 * len(fp)
    a, b = simhash._thin(fp[x], fp[y])
    assert len(a) == len(fp) - 1 and len(set(b.tolist())) == 1


def test_large_tables_lose_no_pair_at_any_radius():
    rnd = np.random.default_rng(8)
    for radius in range(6):
        fp = rnd.integers(0, 1 << 63, 5000, dtype=np.uint64)
        other = fp[0]
        for k in range(radius):  # a bit in each sub-segment but one
            other ^= np.uint64(1) << np.uint64(k * -(-64 // (radius + 1)))
        fp = np.unique(np.append(fp, other))
        x, y = simhash._near(fp, radius)
        linked = {tuple(sorted(p)) for p in zip(fp[x].tolist(), fp[y].tolist())}
        assert radius == 0 or tuple(sorted((int(fp[fp == other][0]), int(other ^ np.bitwise_xor.reduce([np.uint64(1) << np.uint64(k * -(-64 // (radius + 1))) for k in range(radius)]))))) in linked


def test_tokens(docs, rows, none):
    library = Tokenizer.from_file(PATH)
    enc = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(e), len(e) > 1024) for r, e in zip(rows, enc))
    assert bag(tokens.token_counts(docs, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((r[0], len(e), sha(np.array(e, "<u4").tobytes()), sha(library.decode(e, skip_special_tokens=False).encode())) for r, e in zip(rows, enc))
    assert bag(tokens.round_trips(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = {(r.doc_id, bytes(r.decoded).decode()) for r in tokens.encoded(docs, PATH).collect()}
    assert back == {(r[0], r[1] or "") for r in rows}
    assert tokens.token_counts(none, PATH).count() == tokens.round_trips(none, PATH).count() == 0


def test_bpe_on_random_text():
    from evigrid.llm.arrays import blocks
    from evigrid.llm.bpe import as_ids, vocabulary
    import pyarrow as pa

    v, rnd = vocabulary(PATH), random.Random(2)
    for alphabet in ("ab cde's \n\t", "abcdefghijklmnopqrstuvwxyz  'revmtld019!?-_éüß½ —　中😀՘"):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 70))) for _ in range(1500)]
        got = []
        for i, j, data, offs in blocks(pa.array(texts), 5000):
            ids, ends = as_ids(v, v.cuts(data.tobytes(), offs), j - i)
            got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert got == [e.ids for e in v.library.encode_batch(texts, add_special_tokens=False)]


def test_decontamination(spark, docs, rows, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = rows[9][1].split(), rows[40][1].split()
    items = [(1, " ".join(a[3:20])), (1, " ".join(a[3:20])), (20, "Quick the"), (3, "zebra nowhere"), (4, None), (5, "  ..."), (None, "one"), (7, " ".join(b[:12]).upper()), (8, "two-words!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        hit, found = [False] * len(w), set()
        for k, t in items:
            p = words(t) if k is not None else []
            n = min(10, len(p))
            for i in range(len(p) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit[j : j + n] = [True] * n
                        found.add(str(k))
        want[(r[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))] += 1
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(decontaminate.contamination(docs, bench), *cols) == want
    assert bag(decontaminate.contamination(docs, bench, most_bytes=1500), *cols) == want  # several passes
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_ordinal(spark, docs, rows, none):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    made = []
    for i in range(900):
        g = i % 3
        t = [rnd.choice(words) for _ in range(40)] + [["awful", "nasty"], ["dull", "plain"], []][g] * 2
        rnd.shuffle(t)
        made.append((i, " ".join(t), int(g == 2), int(g == 0)))
    df = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int")
    model = ordinal.fitted(df.where("doc_id < 600"), ordinal.graded(df.select("doc_id", "quality", "toxic")))
    assert (np.diff(model.thresholds) > 0).all()
    held = ordinal.scored(df.where("doc_id >= 600"), model).collect()
    right = sum(r.kept == (r.doc_id % 3 == 2) for r in held)
    assert right >= 0.97 * len(held)
    mean = [np.mean([r.expected_grade for r in held if r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert ordinal.scored(docs, model).count() == len(rows)
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text", "quality", "toxic")
    again = ordinal.fitted(named.where("doc_id < 'd6'").union(named), ordinal.graded(named.select("doc_id", "quality", "toxic")))
    assert ordinal.scored(named, again).where("kept").count() > 200
    assert ordinal.scored(none, ordinal.fitted(none, ordinal.graded(df.limit(0).select("doc_id", "quality", "toxic")))).count() == 0


def test_html(spark):
    notice = "please accept all of our many cookies before you go on reading this"
    pages = [
        (1, "http://a.x/1", "<html><head><title>T</title></head><body><nav>Menu</nav><article><h1>Head &amp; tail</h1><p>One\n two<br>three<p>Four <b>bold</b></article><footer>Foot</footer>"),
        (2, "http://a.x/2", "<main><p>Body</p><div class='comments'><p>First!</p></div><form>Name</form><aside>Side</aside><script>var t='</p>';</script></main>"),
        *((10 + i, f"http://b.x/{i}", f"<body><div>{notice}</div><p>Only page {i} says this &#233;</p><div class='ad'>Buy</div></body>") for i in range(4)),
        (20, "http://c.x/", f"<body><div>{notice}</div><p>Alone</p></body>"),
        (21, None, None),
        (None, "http://c.x/e", ""),
        (22, "http://c.x/f", "<p hidden>no</p><p>yes<!-- x --><div"),
        (1, "http://a.x/1", "<article>again</article>"),
    ]
    df = spark.createDataFrame([p + ("z",) for p in pages], "page_id long, url string, html string, text string")
    got = html.main_texts(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    text = {(r.page_id, r.url): r.text for r in got if r.page_id != 1}
    assert {r.text for r in got if r.page_id == 1} == {"Head & tail\nOne two three\nFour bold", "again"}
    assert text[(2, "http://a.x/2")] == "Body"
    assert [text[(10 + i, f"http://b.x/{i}")] for i in range(4)] == [f"Only page {i} says this é" for i in range(4)]
    assert text[(20, "http://c.x/")] == f"{notice}\nAlone"  # on one page of its host only
    assert text[(21, None)] == text[(None, "http://c.x/e")] == ""
    assert text[(22, "http://c.x/f")] == "yes"
    assert html.main_texts(df.limit(0)).count() == 0
