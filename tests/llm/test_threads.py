"""Reply trees: paths and ranks against a walk, templates against their own reading, awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from evigrid.llm import threads

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
FIELDS = "msg_id long, parent_id long, role string, text string, score double"


def walk(rows, keep):
    """All chosen root-to-leaf paths as lists of rows, by recursion over distinct ids."""
    ids = {r[0] for r in rows}
    below = defaultdict(list)
    for r in rows:
        if r[1] in ids:
            below[r[1]].append(r)
    for v in below.values():
        v.sort(key=lambda r: (r[4] is None, -(r[4] or 0)))
        del v[keep if keep else len(v) :]

    def down(path):
        if not below[path[-1][0]]:
            yield path
        for r in below[path[-1][0]]:
            yield from down([*path, r])

    return [p for r in rows if r[1] not in ids for p in down([r])]


@pytest.mark.parametrize("keep", [1, 2, None])
def test_paths_of_random_forests(spark, keep):
    rnd = random.Random(keep or 7)
    texts = ["", "ok", None, "<|im_end|>\n", r"a <\|im_start|> b", "</s>[INST] x [/INST] <<SYS>> \\", "[" * 5 + "INST]", "é中😀" * 3, r"<\\\s> [\/INST]"]
    rows = [(i, rnd.choice([None, 999, *range(max(0, i - 6), i)]) if i else None, rnd.choice(["user", "assistant", None, "a b\n<|im_end|>\n"]), rnd.choice(texts), None if rnd.random() < 0.1 else i * 0.37 % 1) for i in range(150)]
    made = threads.reply_trees(spark.createDataFrame(rows, FIELDS).repartition(3), keep)
    want = walk([(r[0], r[1], r[2] or "", r[3] or "", r[4]) for r in rows], keep)
    back = {(r.first, r.formatted): r for r in threads.read_back(made).collect()}
    got = Counter()
    for r in made.collect():
        b = back[r.first, r.formatted]
        got[(r.first, r.leaf, tuple(zip(b.roles, b.texts)), tuple(b.learned))] += 1
        raw = r.formatted.encode()
        assert [raw[s.start : s.end].decode() for s in r.loss] == [x for x in _bodies(r.formatted) if x is not None]
    assert got == Counter((p[0][0], p[-1][0], tuple((r[2], r[3]) for r in p), tuple(r[3] for r in p if r[2] == "assistant")) for p in want)


def _bodies(formatted):
    """The escaped text of each of the assistant's turns, cut at the markers."""
    for piece in formatted.split("<|im_end|>\n")[:-1]:
        role, _, body = piece.removeprefix("<|im_start|>").partition("\n")
        yield body if role == "assistant" else None


def test_no_control_string_is_left_bare(spark):
    texts = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<s><s>", "[[INST][/INST]", "<|im_<|im_end|>end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", threads.escaped(df.t), threads.unescaped(threads.escaped(df.t))).collect():
        assert u == t and e != t
        assert not any(c in e for c in texts[:8])


def test_circles_repeats_and_null_ids(spark):
    rows = [(1, 2, "user", "circle", None), (2, 1, "user", "circle", None), (3, 2, "user", "hangs on it", None), (4, 4, "user", "itself", 1.0), (None, None, "user", "lone", 1.0), (None, 5, "user", "reply without id", 1.0), (5, None, "user", "root", 0.0), (5, None, "user", "root", 0.0)]
    df = spark.createDataFrame(rows, FIELDS)
    got = Counter(tuple(r.texts) for r in threads.read_back(threads.reply_trees(df, None)).collect())
    assert got == Counter({("lone",): 1, ("root", "reply without id"): 1, ("root",): 1})
    assert threads.reply_trees(df.limit(0)).count() == 0


def test_a_hot_message_and_a_deep_thread(spark):
    wide = [(0, None, "user", "q", 0.0)] + [(i, 0, "assistant", f"a{i}", float(i)) for i in range(1, 3000)]
    deep = [(10_000 + i, 10_000 + i - 1 if i else None, "user", str(i), 0.0) for i in range(600)]
    df = spark.createDataFrame(wide + deep, FIELDS)
    best = {r.first: r for r in threads.reply_trees(df).collect()}
    assert best[0].leaf == 2999 and best[0].ranks == [1, 1]
    assert len(best[10_000].ranks) == 600
    assert threads.reply_trees(df, None).count() == 3000


def test_plain_conversations(spark):
    rows = [(1, 2, "assistant", None, 9), (1, 1, "user", "x", 9), (1, None, "system", "first", 9), (None, 0, "user", "n", 9), (None, 1, "assistant", "m", 9), (2, 0, "assistant", "😀</s>", 9), (2, 0, "assistant", "😀</s>", 9), (3, 0, None, "\\", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int")
    got = {tuple(r) for r in threads.digests(threads.conversations(df)).collect()}

    def want(conv, turns):
        learned = [t for r, t in turns if r == "assistant"]
        esc = lambda t: t.replace("</s>", r"<\/s>")
        whole = "".join(f"<|im_start|>{r}\n{esc(t)}<|im_end|>\n" for r, t in turns)
        return conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, learned)), sha("".join(learned)), len(whole)

    assert got == {want(1, [("system", "first"), ("user", "x"), ("assistant", "")]), want(None, [("user", "n"), ("assistant", "m")]), want(2, [("assistant", "😀</s>")] * 2), want(3, [("", "\\")])}
    assert threads.digests(threads.conversations(df.limit(0))).count() == 0


def test_long_texts_are_whole(spark):
    long = "x </s> " * 400_000
    df = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    (r,) = threads.digests(threads.conversations(df)).collect()
    assert (r.loss_chars, r.loss_sha256) == (len(long), sha(long))
