"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints at most four bits apart
differ by at most one bit in some segment, so each fingerprint stands in the
tables of its own segment values and is looked up in those of the values one bit
away. Tables are shuffle keys; a task verifies complete distances inside a table
and hands on a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks
from evigrid.operators.components import connected_components
from evigrid.plans.lineage import partitions, written

U = np.uint64
SEED = 42
#: Low bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Tables up to this size are compared row by row; larger ones are cut first, into tables of radius + 1
#: sub-segments of the whole fingerprint: of these one is equal in every linked pair.
TABLE = 4096


def fingerprint(words: list[bytes], size: int = 4) -> int:
    """Bits set in over half the hashes of the shingles; no words: zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - size + 1)
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[s:e], SEED) for s, e in zip(starts[:k].tolist(), ends[len(words) - k :].tolist())], U)
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` of every row; A-Z are lower-cased, a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                raw, cut = data.tobytes().lower(), offs.tolist()
                fp = np.array([fingerprint(raw[x:y].split(), size) for x, y in zip(cut, cut[1:])], U)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _near(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, a node at a time."""
    n = len(fp)
    if n > TABLE:
        width, a, b = -(-64 // (radius + 1)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(radius + 1):
            value = (fp >> U(s * width)) & U((1 << width) - 1)
            order = np.argsort(value, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if 1 < len(part):
                    x, y = _forest(fp[part], radius)
                    a.append(part[x])
                    b.append(part[y])
        return np.concatenate(a), np.concatenate(b)
    return _forest(fp, radius)


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                got, left = left[near], left[~near]
                a += [x] * len(got)
                b += got.tolist()
                queue += got.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _links_of(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys; most runs are short and compared all at once."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    a, b = [], []
    small = size <= 32
    group_end = np.repeat(first + size, size)
    rows = np.flatnonzero(np.repeat(small & (size > 1), size))
    for d in range(1, int(size[small].max(initial=1))):
        rows = rows[rows + d < group_end[rows]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= radius]
        a.append(fp[near])
        b.append(fp[near + d])
    x, y = np.concatenate([np.zeros(0, U), *a]), np.concatenate([np.zeros(0, U), *b])
    for f, s in zip(first[~small].tolist(), size[~small].tolist()):
        i, j = _near(fp[f : f + s], radius)
        x, y = np.concatenate([x, fp[f : f + s][i]]), np.concatenate([y, fp[f : f + s][j]])
    return _thin(x, y)


def _thin(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per node: each node to the least one it reaches."""
    if not len(x):
        return x, y
    node, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = where[: len(x)], where[len(x) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``(a, b)``: links that connect just what fingerprints at most ``radius`` bits apart connect.

    ``fps`` has distinct non-null ``fp``. The three segments serve a radius up to 5.
    A table holds the distinct fingerprints with one segment value: N / 2^21 of them
    by chance, and at most the neighbours of a cluster's centre on the other bits.
    """
    if not 0 <= radius <= 5:
        raise ValueError("three segments with balls of one bit serve a radius up to 5")
    spark = fps.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(U)
            for low, width in SEGMENTS:
                value = (fp >> U(low)) & U((1 << width) - 1)
                keys, rows = [value], [fp]
                for bit in range(width):  # of two values one bit apart, the one without the bit looks the other up
                    off = (value >> U(bit)) & U(1) == 0
                    keys.append(value[off] | U(1 << bit))
                    rows.append(fp[off])
                key = np.concatenate(keys) | U(low << 32)
                for i in range(0, len(key), 1 << 18):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[i : i + (1 << 18)].view(np.int64)), pa.array(np.concatenate(rows)[i : i + (1 << 18)].view(np.int64))],
                        names=["k", "fp"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, U), np.zeros(0, U)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            x, y = _links_of(key, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            k, f = (b.column(c).to_numpy(zero_copy_only=False).view(U) for c in (0, 1))
            held.append((k, f))
            if k[0] == k[-1] and held[0][0][0] == k[0]:
                continue  # one table so far
            key, fp = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            end = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield out(key[:end], fp[:end])
            held = [(key[end:], fp[end:])]
        if held:
            yield out(*(np.concatenate([h[c] for h in held]) for c in (0, 1)))

    tables = fps.select("fp").mapInArrow(spread, "k long, fp long").repartition(partitions(spark), "k").sortWithinPartitions("k")
    return tables.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    Fingerprints at most ``radius`` bits apart are linked; ``component_id`` is the least
    doc_id that links reach, the row's own included. Rows without words have fingerprint
    zero and are linked like any others. Repeated rows give repeated results. A null
    doc_id takes part in the links but is no component's least id, unless its component
    has none but null ids: then the component is null. An empty table gives no rows; very
    long texts are read whole; other columns are not looked at.
    """
    each = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    fps = each.groupBy("fp").agg(F.min(id_col).alias("least"))
    stars = connected_components(links(fps.select("fp"), radius))
    rooted = fps.join(
        stars.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left",
    ).select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = each.join(rooted.join(least, "root").select("fp", "component_id"), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
