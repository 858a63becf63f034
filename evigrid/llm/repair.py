"""Conversation structure repair: the cheapest edits that give ``(system? (user assistant)+)?``.

Role sequences are accepted by four states: 0 nothing yet, 1 after the system turn, 2 after a
user, 3 after an assistant; 0 and 3 may end. Nodes of the edit graph are (rows read, state), its
arcs are edits: Delete, Insert, Keep, Rerole. Costs from the start and costs to the end say which
arcs are *tight*, that is, on some cheapest path; a traversal takes the set of nodes that the
least letters so far can stand at, and goes on with the least letter that leaves it by a tight arc.

Rows are sorted by range over the whole table, so that a conversation of any length is cut into
runs of bounded size, each in its own task. A run is summed up by the least costs between its
states (a 4 x 4 matrix); the matrices of a conversation's runs give the costs at their borders,
from which every run finds its own tight arcs and letters. Only digests need a conversation in
order in one task, which reads it as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.plans.lineage import partitions, written

FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: (state, initial) -> state; what is not here is not accepted.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
STATES, ENDS = range(4), (0, 3)
#: (state, state) of an inserted or a reroled turn: one of user and assistant fits, never both.
FILL = {q: r for (q, c), r in NEXT.items() if c in "ua"}
ROLE = {2: "user", 3: "assistant"}
INITIALS = "sua?"
CODE = {"s": 0, "u": 1, "a": 2}
BLANK = r"[\x20\x09-\x0D]"


def _code(initial: int, gone: bool, cut: bool) -> int:
    """A row as the graph sees it: its role's initial, whether it must go, whether it is truncated."""
    return initial + 4 * gone + 8 * (cut and not gone)


def _arcs(code: int) -> Iterator[tuple[str, int, int, int]]:
    """``(letter, state, next state, cost)`` of the arcs that read a row of this code."""
    for q in STATES:
        yield "D", q, q, DELETE
        if not code & 4:
            more = TRUNCATED * bool(code & 8)
            if (r := NEXT.get((q, INITIALS[code & 3]))) is not None:
                yield "K", q, r, KEEP + more
            yield "R", q, FILL[q], REROLE + more


ARCS = [tuple(_arcs(c)) for c in range(16)]


def _filled(costs: list[int]) -> list[int]:
    """Least costs once turns may have been inserted; two are enough to get anywhere."""
    out = list(costs)
    for _ in range(2):
        for q, r in FILL.items():
            out[r] = min(out[r], out[q] + INSERT)
    return out


def _fillable(costs: list[int]) -> list[int]:
    """The same from the other end: least costs to the end from before the insertions."""
    out = list(costs)
    for _ in range(2):
        for q, r in FILL.items():
            out[q] = min(out[q], INSERT + out[r])
    return out


def _forward(codes: bytes, start: list[int]) -> list[list[int]]:
    """Least costs of each state before each row and after the last, insertions before a row included;
    those after the last row belong to what comes next."""
    at = [_filled(start)]
    for i, c in enumerate(codes):
        new = [FAR] * 4
        for _, q, r, cost in ARCS[c]:
            new[r] = min(new[r], at[-1][q] + cost)
        at.append(_filled(new) if i + 1 < len(codes) else new)
    return at


def _backward(codes: bytes, end: list[int]) -> list[list[int]]:
    """Least costs from each state before each row, insertions still to come, to the end."""
    at = [end]
    for c in reversed(codes):
        new = [FAR] * 4
        for _, q, r, cost in ARCS[c]:
            new[q] = min(new[q], cost + at[-1][r])
        at.append(_fillable(new))
    return at[::-1]


def _kept(f):
    """Short runs are mostly alike: what was found for them is kept."""
    short = lru_cache(1 << 14)(f)

    @wraps(f)
    def found(codes, *more):
        return (short if len(codes) <= 64 else f)(codes, *more)

    return found


@_kept
def _matrix(codes: bytes) -> tuple[int, ...]:
    """Least costs of a run from each state to each, row by row."""
    return tuple(x for s in STATES for x in _forward(codes, [0 if q == s else FAR for q in STATES])[-1])


@_kept
def _letters(codes: bytes, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[tuple[str, int, int] | None, ...]:
    """For each state in which a cheapest path may enter the run: the least letters of the cheapest
    paths through it, the state they leave it in, and their cost.

    ``before``: least costs from the conversation's start to the run's; ``after``: from its end to
    the conversation's end, insertions there included.
    """
    f, b = _forward(codes, list(before)), _backward(codes, list(after))
    best = min(x + y for x, y in zip(f[0], b[0]))

    def tight(i: int, q: int, cost: int, j: int, r: int) -> bool:
        return f[i][q] + cost + b[j][r] == best

    def walk(state: int) -> tuple[str, int, int] | None:
        if before[state] + b[0][state] != best:
            return None
        out, here = [], {state}
        for i, c in enumerate(codes):
            while True:
                found: dict[str, set[int]] = {}
                for letter, q, r, cost in ARCS[c]:
                    if q in here and tight(i, q, cost, i + 1, r):
                        found.setdefault(letter, set()).add(r)
                inserted = {FILL[q] for q in here if tight(i, q, INSERT, i, FILL[q])}
                if inserted:
                    found["I"] = inserted
                letter = min(found)
                out.append(letter)
                here = found[letter]
                if letter != "I":
                    break
        (last,) = here  # states follow from letters
        return "".join(out), last, f[-1][last] - before[state]

    return tuple(walk(q) for q in STATES)


#: Least costs from a state after the last row to the end, and the insertions that take them.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}
AT_END = [INSERT * len(CLOSING[q]) for q in STATES]
AT_START = [0, FAR, FAR, FAR]


def _keys(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, print)``: nulls of role and text are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("print"))


def faults(keyed: DataFrame) -> DataFrame:
    """``(conv, turn, role, print, n, empty, cut, new)`` of every distinct row; ``n`` is how often it occurs,
    ``new`` that its role and text occur at no earlier turn.

    Texts are told apart by their SHA-256. Nothing is gathered by conversation: a row's first
    occurrence is a grouped minimum over (conversation, role, text).
    """
    empty, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(rf"[.!?]{BLANK}*\z")
    cells = keyed.groupBy("conv", "turn", "role", "print", empty.alias("empty"), cut.alias("cut")).agg(F.count("*").alias("n"))
    firsts = cells.groupBy("conv", "role", "print").agg(F.min(F.struct("turn")).alias("first"))  # nulls first
    a, b = cells.alias("a"), firsts.alias("b")
    same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.print") == F.col("b.print"))
    return a.join(b, same).select("a.*", F.col("a.turn").eqNullSafe(F.col("b.first.turn")).alias("new"))


#: Rows in a run, at most.
MOST = 1 << 16


class _Run:
    """What is known of a run while its rows come in."""

    def __init__(self, conv: object) -> None:
        self.conv, self.codes, self.turns = conv, bytearray(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None

    def add(self, turn: object, initial: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        if self.codes and INITIALS[self.codes[-1] & 3] + INITIALS[initial] not in ("su", "ua", "au"):
            self.illegal += 1
        self.codes.append(_code(initial, blank or duplicate, truncated))
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self, number: int) -> tuple:
        codes = bytes(self.codes)
        return self.conv, number, self.blank, self.duplicate, self.truncated, self.illegal, self.low, self.high, self.turns, codes[0] & 3, codes[-1] & 3, codes, list(_matrix(codes))


def runs(faulty: DataFrame) -> DataFrame:
    """One row for each run of a conversation in a sorted partition, ``MOST`` rows at most: counts, what
    stands at its ends, the codes of its rows (a byte each) and its matrix. ``first`` orders runs."""
    kinds = {c: faulty.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    columns = {"conv": kinds["conv"], "first": "long", **dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), "long"), "low": kinds["turn"], "high": kinds["turn"], "turns": "long", "head": "int", "tail": "int", "codes": "binary", "matrix": "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, number, shape = None, [], TaskContext.get().partitionId() << 33, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), shape)], names=list(columns))

        for b in batches:
            conv, turn = b.schema.field("conv").type, b.schema.field("turn").type
            long, short = pa.int64(), pa.int32()
            shape = [conv, long, long, long, long, long, turn, turn, long, short, short, pa.binary(), pa.list_(long)]
            cols = (b.column(c).to_pylist() for c in ("conv", "turn", "role", "n", "empty", "cut", "new"))
            for conv, turn, role, n, empty, cut, new in zip(*cols):
                initial = CODE.get(role[:1], 3)
                for k in range(n):
                    if now is None or now.conv != conv or len(now.codes) >= MOST:
                        if now:
                            done.append(now.row(number))
                            number += 1
                        now = _Run(conv)
                    again = k > 0 or not new
                    now.add(turn, initial, empty, not empty and again, not empty and not again and cut)
            if len(done) >= 4096:
                yield out()
                done = []
        if now:
            done.append(now.row(number))
            yield out()

    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "print")]
    dealt = faulty.repartitionByRange(partitions(faulty.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in columns.items()))


def _borders(found: DataFrame) -> DataFrame:
    """``(conv, first, before, after)``: least costs at both ends of the runs of conversations that have
    several: 16 numbers for each of its runs are gathered, that is, for 65,536 rows or a border of partitions."""
    kind = found.schema["conv"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                conv, parts = b.column(0).slice(r, 1), b.column(1)[r].as_py()
                before, after = [AT_START], [AT_END]
                for p in parts[:-1]:
                    start = before[-1]
                    before.append([min(start[q] + p["matrix"][4 * q + s] for q in STATES) for s in STATES])
                for p in reversed(parts[1:]):
                    end = after[-1]
                    after.append([min(p["matrix"][4 * q + s] + end[s] for s in STATES) for q in STATES])
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([conv] * n), pa.array([p["first"] for p in parts], pa.int64()), pa.array(before, pa.list_(pa.int64())), pa.array(after[::-1], pa.list_(pa.int64()))],
                    names=["conv", "first", "before", "after"],
                )

    several = found.groupBy("conv").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("first", "matrix"))).alias("parts")).where("n > 1")
    return several.select("conv", "parts").mapInArrow(scan, f"conv {kind}, first long, before array<long>, after array<long>")


def audits(found: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation in ``found`` (``runs``)."""
    borders = _borders(found).select("first", "before", "after")
    placed = found.join(borders, "first", "left")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for codes, before, after in zip(*(b.column(c).to_pylist() for c in ("codes", "before", "after"))):
                ways = _letters(codes, tuple(before or AT_START), tuple(after or AT_END))
                rows.append([dict(zip(("letters", "state", "cost"), w)) if w else None for w in ways])
            kind = pa.list_(pa.struct([("letters", pa.string()), ("state", pa.int32()), ("cost", pa.int64())]))
            keep = [n for n in b.schema.names if n not in ("codes", "before", "after")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(rows, kind)], names=[*keep, "ways"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name not in ("codes", "before", "after"))
    spelt = placed.mapInArrow(spell, schema + ", ways array<struct<letters: string, state: int, cost: bigint>>")
    parts = F.array_sort(F.collect_list(F.struct("first", "head", "tail", "low", "high", "matrix", "ways")))
    whole = spelt.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")), F.min("low").alias("low"), F.max("high").alias("high"), parts.alias("parts")
    )
    p = F.col("parts")
    zero = F.struct(F.lit(0).alias("state"), F.lit("").alias("audit"), F.lit(0).cast("long").alias("cost"), F.lit(-1).alias("tail"), F.lit(None).cast(found.schema["high"].dataType).alias("high"), F.lit(0).alias("illegal"), F.lit(0).alias("same"))

    def step(a: Column, x: Column) -> Column:
        way = F.get(x["ways"], a["state"])
        fits = F.concat(*(F.element_at(F.array(*map(F.lit, INITIALS)), y + 1) for y in (F.greatest(a["tail"], F.lit(0)), x["head"])))
        return F.struct(
            way["state"].alias("state"),
            F.concat(a["audit"], way["letters"]).alias("audit"),
            (a["cost"] + way["cost"]).alias("cost"),
            x["tail"].alias("tail"),
            F.coalesce(x["high"], a["high"]).alias("high"),
            (a["illegal"] + F.when((a["tail"] >= 0) & ~fits.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal"),
            (a["same"] + F.when(a["high"] == x["low"], 1).otherwise(0)).alias("same"),
        )

    close = F.create_map(*(F.lit(x) for q in STATES for x in (q, CLOSING[q])))
    folded = whole.select("*", F.explode(F.array(F.aggregate(p, zero, step))).alias("f"))
    audit = F.concat("f.audit", close[F.col("f.state")])
    cost = F.col("f.cost") + F.element_at(F.array(*map(F.lit, AT_END)), F.col("f.state") + 1)
    return folded.select(
        "conv",
        F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - F.col("f.same")), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated",
        (F.col("illegal") + F.col("f.illegal")).alias("illegal"),
        cost.cast("long").alias("cost"),
        audit.alias("audit"),
    )


def _streamed(keyed: DataFrame, audited: DataFrame, digest: bool) -> DataFrame:
    """The rows that audits make of conversations, or their digests: a conversation's audit comes first,
    then its rows in order, and neither is ever held whole but the audit."""
    kind = keyed.schema["conv"].dataType.simpleString()
    given = keyed.select("conv", F.lit(1).alias("part"), "turn", "role", "print", "text")
    marks = audited.select("conv", F.lit(0).alias("part"), F.lit(None).cast(keyed.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("print"), F.col("audit").alias("text"))
    order = [F.asc_nulls_first(c) for c in ("conv", "part", "turn", "role", "print")]
    both = given.unionByName(marks).repartition(partitions(keyed.sparkSession), "conv").sortWithinPartitions(*order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, sha, n, shape = None, "", 0, 0, None, 0, None

        def put(letter: str, role: str, text: str) -> None:
            nonlocal state, n
            state = NEXT[state, role[:1]] if letter == "K" else FILL[state]
            role = role if letter == "K" else ROLE[state]
            if digest:
                sha.update(("\n" * (n > 0) + f"{role}:{text}").encode("utf-8", "surrogateescape"))
            else:
                made.append((conv, n, letter, role, text))
            n += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", "", "")
                at += 1

        for b in batches:
            made = []
            shape = shape or b.schema.field("conv").type
            for c, part, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "part", "role", "text"))):
                if part == 0:
                    if digest and sha:
                        made.append((conv, sha.hexdigest()))
                    conv, audit, at, state, sha, n = c, text, 0, 0, hashlib.sha256(), 0
                else:
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        put(letter, role, text)
                inserted()
            yield out(made, shape)
        if digest and sha:
            yield out([(conv, sha.hexdigest())], shape)

    def out(made: list, conv: pa.DataType) -> pa.RecordBatch:
        kinds = [conv, pa.string()] if digest else [conv, pa.int64(), pa.string(), pa.string(), pa.string()]
        cols = zip(*made) if made else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=NAMES[digest])

    schema = f"conv {kind}, repaired_sha256 string" if digest else f"conv {kind}, at long, edit string, role string, text string"
    return both.mapInArrow(read, schema)


NAMES = {True: ["conv", "repaired_sha256"], False: ["conv", "at", "edit", "role", "text"]}


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(audits, turns)`` of conversations ``(conv_id, turn, role, text)``.

    ``audits`` has the faults of every conversation, the cost of its cheapest edits and the letters of
    the ASCII-least of these; ``turns`` the rows ``(conv_id, at, edit, role, text)`` that they leave,
    ``at`` from 0. Rows go by turn (a whole number), nulls first, equal ones by role and SHA-256 of the
    text; nulls of role and text are one space; rows with a null conversation are one conversation.
    Repeated rows are duplicates. Empty texts are blank, very long ones are read whole. Other columns
    are not looked at; an empty table gives none.
    """
    keyed = _keys(rows)
    audited = written(audits(written(runs(faults(keyed)), "runs")), "audits")
    return audited.withColumnRenamed("conv", "conv_id"), _streamed(keyed, audited, False).withColumnRenamed("conv", "conv_id")


def digests(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every id in
    ``all_ids``; one without rows has zeros, an empty audit and the digest of nothing."""
    keyed = _keys(rows)
    audited = written(audits(written(runs(faults(keyed)), "runs")), "audits")
    a, d = audited.alias("a"), _streamed(keyed, audited, True).alias("d")
    found = a.join(d, F.col("a.conv").eqNullSafe(F.col("d.conv"))).select("a.*", "repaired_sha256").alias("f")
    ids = all_ids.select("conv_id").distinct().alias("i")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    whole = ids.join(found, F.col("i.conv_id").eqNullSafe(F.col("f.conv")), "left")
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with every twentieth row dropped, emptied, cut, repeated or given to the user, by
    the CRC-32 of ``conv_id:turn``; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    hurt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    given = rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).where("fate <> 0")
    return given.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(text("role")).alias("role"), hurt.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
