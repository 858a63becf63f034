"""Conversation repair against a search over all edits, and on awkward rows."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from evigrid.llm import repair

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        if k == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if k == 3 else 1)


def fault(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, rows left): letters are searched in order of cost, then ASCII, over whole role sequences."""
    fits = lambda s: s[:1] in ("s", "u", "") and all(a + b in ("su", "ua", "au") for a, b in zip(s, s[1:]))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, left = heapq.heappop(heap)
        now = "".join(r[0][:1] or "?" for r in left)
        if i == len(rows) and (not now or now[-1] == "a"):
            return cost, audit, left
        if (i, now[:1] == "s", now[-1:]) in done:
            continue
        done.add((i, now[:1] == "s", now[-1:]))
        for role in ("user", "assistant"):
            if fits(now + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, (*left, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, left))
            if marks[i] not in ("blank", "duplicate"):
                for letter, price, new in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    if new[:1] and fits(now + new[0]):
                        heapq.heappush(heap, (cost + price + (marks[i] == "truncated"), audit + letter, i + 1, (*left, (new, text))))


def want(rows, hurt):
    groups = defaultdict(list)
    for r in hurt:
        groups[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        marks = fault(own)
        cost, audit, left = cheapest(own, marks)
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))


def chats(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "So? ", "", " \t", None, "é!\n", "a b c.", "x" * 50, "end ?!", " ", "Yes.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "Agent", "s"]
    for conv in range(n):
        for _ in range(rnd.randint(0, longest)):
            turn = rnd.choice([None, *range(12)]) if rnd.random() < 0.3 else rnd.randint(0, 400)
            yield conv if conv else None, turn, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.7 else f"text {rnd.random()}" + rnd.choice(".,")


FIELDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_against_a_search_over_all_edits(spark, most, monkeypatch):
    """Also with runs of three rows, so that every conversation is cut."""
    rows = list(chats(3, 120, 9)) + [(999, k, "user", f"{k}.") for k in range(30)]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    monkeypatch.setattr(repair, "MOST", most)
    got = {tuple(r) for r in repair.digests(repair.damaged(df), df).collect()}
    assert got == set(want(rows, list(damage(rows))))


def test_a_long_conversation_is_cut_into_partitions(spark):
    """One conversation with most rows is sorted over several partitions."""
    rnd = random.Random(4)
    rows = [(1, k, rnd.choice(["user", "assistant"]), f"word {rnd.randint(0, 2000)}" + rnd.choice(".. ")) for k in range(3000)] + list(chats(5, 20, 5))
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    found = repair.runs(repair.faults(repair._keys(repair.damaged(df))))
    assert found.where("conv = 1").count() > 2
    got = {tuple(r) for r in repair.digests(repair.damaged(df), df).collect()}
    assert got == set(want(rows, list(damage(rows))))


def test_rows_that_edits_leave(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Hm"), (1, 3, "user", "Hm"), (2, 0, "user", " ")]
    audits, turns = repair.repaired(spark.createDataFrame(rows, FIELDS + "").selectExpr("*", "1 AS at", "2 AS conv"))
    assert {(r.conv_id, r.audit, r.cost) for r in audits.collect()} == {(1, "KIKDD", 8), (2, "D", 3)}
    assert [tuple(r) for r in turns.orderBy("at").collect()] == [(1, 0, "K", "system", "Be kind."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hi.")]


def test_no_rows(spark):
    df = spark.createDataFrame([], FIELDS)
    assert repair.digests(repair.damaged(df), df).count() == 0
    audits, turns = repair.repaired(df)
    assert audits.count() == turns.count() == 0
