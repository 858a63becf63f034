"""Values that very many rows share: found by sketches, joined over grids of tasks, matched in cells of owners."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.plans.lineage import partitions, written

#: Rows of one side of a value that a task joins, at most about.
CELL = 4096
#: Matches that a cell of owners works off at once, about, and rows of a side of a cell.
MATCHES, ROWS = 1 << 21, 1 << 20
#: Matches for each pair of owners of a cell from which bitmaps take less than a list of the matches.
DENSE = 1 / 32


def frequent(df: DataFrame, key: Column, most: int) -> DataFrame:
    """``(key, n)`` of the most frequent keys (their 64-bit hashes), by frequent-items sketches of the map
    tasks, merged: ``most`` rows at most. Counts are estimates, exact where few keys are distinct."""
    # The sketch tracks four keys for each one it names, so that what it misses has under 1 / most of all rows.
    tracked = 1 << (8 * most - 1).bit_length()
    top = df.select(F.xxhash64(key).alias("_k")).agg(F.expr(f"approx_top_k(_k, {most}, {tracked})").alias("top"))
    return top.select(F.inline("top").alias("key", "n"))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """Inner join on ``keys``; the pairs of a frequent value are dealt over a grid of tasks.

    A value with m rows on the left and n on the right takes (m / cell) x (n / cell) tasks: a left row
    goes to one line of the grid and is copied to its columns, a right row the other way round. The
    copies are 2 / cell of the pairs that come out. Other values are joined as they are. The
    grids are broadcast: four values for each shuffle partition at most.
    """
    most = 4 * partitions(left.sparkSession)
    mark = F.struct(*keys)
    sides = [frequent(df, mark, most).where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias(n)) for df, n in ((left, "lines"), (right, "columns"))]
    grids = F.broadcast(written(sides[0].join(sides[1], "key", "full_outer").na.fill(1), "grids"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        of = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
        placed = df.withColumn("_key", F.xxhash64(mark)).join(grids.withColumnRenamed("key", "_key"), "_key", "left")
        place = F.pmod(of, F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return placed.select(*df.columns, place.alias(f"_{own}"), copies.alias(f"_{other}"))

    return dealt(left, "lines", "columns").join(dealt(right, "columns", "lines"), [*keys, "_lines", "_columns"]).drop("_lines", "_columns")


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers that tell the values of some columns apart, and the values by number."""
    found = pa.chunked_array([c for col in columns for c in col.chunks], columns[0].type).combine_chunks().dictionary_encode("encode")
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return np.split(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(c) for c in columns])[:-1]), found.dictionary


def _matched(lk: np.ndarray, rk: np.ndarray, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows ``i`` and ``j`` that have one key, in parts of about ``MATCHES`` matches that hold a pair of owners
    ``(a, b)`` whole: owners are halved until a part is small enough."""
    by = j[np.argsort(rk[j], kind="stable")]
    low = np.searchsorted(rk[by], lk[i])
    many = np.searchsorted(rk[by], lk[i], "right") - low
    size = int(many.sum())
    if size > 2 * MATCHES:
        for of, s in sorted(((a, i), (b, j)), key=lambda v: -len(np.unique(v[0][v[1]]))):
            own = np.unique(of[s])
            if len(own) > 1:
                mid = own[len(own) // 2]
                for half in (s[of[s] < mid], s[of[s] >= mid]):
                    yield from _matched(lk, rk, a, b, half if of is a else i, half if of is b else j)
                return
    at = np.arange(size) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    yield np.repeat(i, many), by[at]


@dataclass
class Cell:
    """The rows of a pair of blocks: ``l`` and ``r``, their owners ``a`` and ``b`` as numbers (``names`` by number, one
    for an owner of both sides) and what they are matched on, ``lk`` and ``rk``; ``_k`` of ``l`` tells its keys apart."""

    l: pa.Table  # noqa: E741
    r: pa.Table
    a: np.ndarray
    b: np.ndarray
    lk: np.ndarray
    rk: np.ndarray
    names: pa.Array
    kept: dict[str, Any] = field(default_factory=dict)


def _packed(df: DataFrame, of: str) -> DataFrame:
    """``(of, blob)``: the rows of each block as one compressed value, so that copies of a block are small."""

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = t.drop_columns([of]).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        return pa.table([t.column(of).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[of, "blob"])

    return df.groupBy(of).applyInArrow(pack, f"{of} int, blob binary")


def _unpacked(blobs: list[pa.Scalar]) -> pa.Table | None:
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    return pa.concat_tables(tables) if tables else None


def _cell(lines: pa.Table | None, columns: pa.Table | None, few: pa.Table | None, own: str, other: str) -> Cell | None:
    """Rows of two blocks, and matches that were joined before: each of these has a key of its own. Rows whose
    key the other side does not have are left out."""
    sides = [(lines, 0), (columns, 1)]
    rows = [[t for t in (t,) if t is not None] for t, _ in sides]
    if few is not None:
        rows[0].append(few.select([c for c in few.column_names if not c.startswith("_r_")]))
        of_right = [c for c in few.column_names if c.startswith("_r_")]
        rows[1].append(few.select(of_right).rename_columns([c.removeprefix("_r_") for c in of_right]))
    if not rows[0] or not rows[1]:
        return None
    n = 0 if few is None else few.num_rows
    keys, tables = [], []
    for parts in rows:
        t = pa.concat_tables([p.select(parts[0].column_names) for p in parts])
        k = t.column("_k").to_numpy().copy()
        if n:
            k[len(k) - n :] = -1 - np.arange(n)
        keys.append(k)
        tables.append(t)
    both = np.intersect1d(*keys)
    places = [np.searchsorted(both, k) for k in keys]
    found = [np.flatnonzero(both[np.minimum(at, len(both) - 1)] == k) if len(both) else np.zeros(0, np.int64) for at, k in zip(places, keys)]
    l, r = (t.take(pa.array(f)).combine_chunks() for t, f in zip(tables, found))  # noqa: E741
    (a, b), names = _codes(l.column(own), r.column(other))
    return Cell(l, r, a, b, *(at[f] for at, f in zip(places, found)), names) if len(both) else None


def in_cells(
    left: DataFrame, right: DataFrame, keys: list[str], own: str, other: str, kernel: Callable[[Cell, np.ndarray, np.ndarray], pa.Table],
    schema: str, dense: Callable[[Cell], Iterator[pa.Table] | None],
) -> DataFrame:
    """What ``kernel`` makes of the matches on ``keys`` of every pair of owners ``(own, other)``.

    Owners of both sides are dealt into blocks by hash, pairs of blocks are cells, and a cell is worked
    off in a task: no match is shuffled. Blocks are compressed and copied to their cells; a cell has
    about ``ROWS`` rows of a side, so that copies grow with the rows and not with the matches. Matches
    of keys that are rarer than the blocks' copies are joined and sent to their cell.

    A cell goes to ``dense`` where its owners share much; where they do not, or ``dense`` gives None, to
    ``kernel(cell, i, j)`` in parts, with the matches as row numbers. Both hold a pair of owners whole.
    Null owners and keys match nothing.
    """
    spark = left.sparkSession
    l_cols, r_cols = ([c for c in df.columns if c not in keys] for df in (left, right))
    whole = lambda df, c: written(df.where(F.col(c).isNotNull()), "side")
    left, right = whole(left, own), whole(right, other)
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    shared = written(count(left, "_m").join(count(right, "_n"), keys).withColumn("_k", F.monotonically_increasing_id()), "shared")
    pairs = F.col("_m").cast("double") * F.col("_n")
    total = shared.agg(F.sum(pairs)).first()[0] or 0.0
    side = math.ceil(math.sqrt(max(1, min(3 * partitions(spark), total / (1 << 16)))))
    many = pairs > (F.col("_m") + F.col("_n")) * side
    m, n, light = (x or 0 for x in shared.agg(F.sum(F.when(many, F.col("_m"))), F.sum(F.when(many, F.col("_n"))), F.sum(F.when(~many, pairs))).first())
    side = max(side, math.ceil(max(m, n) / ROWS), math.ceil(math.sqrt(light / MATCHES)))
    marks = shared.select(*keys, "_k", many.alias("_many"))
    l, r = left.join(marks, keys).drop(*keys), right.join(marks, keys).drop(*keys)  # noqa: E741
    block, each = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    cell = (F.col("_line") * side + F.col("_column")).cast("int").alias("_cell")
    lines = _packed(l.where("_many").select(*l_cols, "_k", block(own).alias("_line")), "_line").select("*", each.alias("_column"))
    columns = _packed(r.where("_many").select(*r_cols, "_k", block(other).alias("_column")), "_column").select("*", each.alias("_line"))
    theirs = r.where("NOT _many").select(F.col("_k"), *(F.col(c).alias(f"_r_{c}") for c in r_cols), F.col("_k").alias("_r__k"))
    few = l.where("NOT _many").select(*l_cols, "_k").join(theirs, "_k").withColumns({"_line": block(own), "_column": block(f"_r_{other}")})
    few = _packed(few.select(*l_cols, "_k", *(f"_r_{c}" for c in r_cols), "_r__k", cell), "_cell")
    parts = [df.select(cell if "_line" in df.columns else "_cell", F.lit(k).alias("_kind"), "blob") for k, df in enumerate((lines, columns, few))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
        for _, of in groupby(rows, lambda row: row[0]):
            blobs = list(of)
            c = _cell(*(_unpacked([x for _, k, x in blobs if k == kind]) for kind in range(3)), own, other)
            if c is not None:
                shares = (np.bincount(c.lk).astype(float) * np.bincount(c.rk)).sum()
                out = dense(c) if shares >= DENSE * len(np.unique(c.a)) * len(np.unique(c.b)) else None
                if out is None:
                    out = (kernel(c, i, j) for i, j in _matched(c.lk, c.rk, c.a, c.b, np.arange(len(c.a)), np.arange(len(c.b))))
                for t in out:
                    yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)

    # Cells are small before they are matched: a given number of tasks is not coalesced by their size.
    tasks = min(side * side, 4 * partitions(spark))
    dealt = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartitionById(tasks, F.col("_cell") % tasks)
    return dealt.sortWithinPartitions("_cell", "_kind").mapInArrow(run, schema)
