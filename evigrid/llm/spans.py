"""Repeated spans across documents: finding candidates, settling who was first, applying.

Both span operators (words, bytes) work in the same three passes over the texts:

1. *Anchors*, short windows that any long match must share, are hashed. Which
   hashes occur in two documents or more is found by a shuffle of hashes alone and
   kept as a bitmap of fixed size. It may say yes too often, never no too often.
2. Around the marked anchors the full windows are settled: equal windows meet in
   one task, the least doc_id keeps its own, the others are flagged. A map task
   first settles what it has itself, so that a passage in a third of all rows
   leaves it once per task and not once per row.
3. Flags go back to their texts, which are shuffled once.

The bitmap has 16 bits for each shared anchor, up to 2^``FILTER_BITS`` in all; beyond, it says
yes more and more often: more to shuffle in pass 2, the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks, giving_back, mix
from evigrid.plans.lineage import partitions, written

U = np.uint64
#: Most bits of the broadcast bitmap (128 MB), and bits for each shared anchor below that.
FILTER_BITS = 30
LOAD = 16
#: Anchors that a task gathers before it hands them on.
FLUSH = 2_000_000

Anchors = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with whole numbers for ids, and how to get the ids back into ``doc_id`` of a result.

    Whole numbers stand for themselves. Other ids (text, decimals, dates) are numbered in their order,
    by a sort over ranges of all distinct ones; null stays null.
    """
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs, lambda df: df
    own = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    ids = written(own.repartitionByRange(partitions(docs.sparkSession), "_id").sortWithinPartitions("_id").select("_id", F.monotonically_increasing_id().alias("_n")), "ids")
    def exchanged(df: DataFrame, old: str, new: str) -> DataFrame:
        mine = ids.select(F.col(old).alias("__old_id"), F.col(new).alias("__new_id"))
        both = df.join(mine, F.col(f"`{id_col}`") == F.col("__old_id"), "left")
        return both.select(*(F.col("__new_id").alias(c) if c == id_col else F.col(f"`{c}`") for c in df.columns))

    return exchanged(docs, "_id", "_n"), lambda df: exchanged(df, "_n", "_id")


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, tag, text)``; the tag tells rows that repeat a doc_id with another text apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def buckets_of(spark) -> int:
    return min(4 * partitions(spark), 65536)


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the top 16 bits."""
    return ((h >> U(48)) * U(n) >> U(16)).astype(np.int64)


def split_by(which: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, indexes)`` for each bucket that has rows."""
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=n))
    for k, (i, j) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
        if i < j:
            yield k, order[i:j]


def _fold(parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the number of documents they came from, counted up to ``least``."""
    h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    if not len(h):
        return h, n
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.minimum(np.add.reduceat(n, first), least).astype(np.uint8)


@dataclass
class Filter:
    """A broadcast bitmap of the low ``bits`` of hashes."""

    bits: int
    shared: Broadcast

    def marked(self, h: np.ndarray) -> np.ndarray:
        slot = h & U((1 << self.bits) - 1)
        return (self.shared.value[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1


def shared_filter(texts: DataFrame, anchors: Anchors, bits: int = FILTER_BITS, least: int = 2) -> Filter:
    """Bitmap of the anchor hashes that ``least`` documents or more share, of at most 2^``bits`` bits.

    Only 4 bytes of each hash are moved beside its bucket, once per task and distinct hash, in
    runs by their count; a false share only marks more than is needed.
    """
    spark = texts.sparkSession
    n = buckets_of(spark)
    low = U((1 << 32) - 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            h, count = _fold(parts, least)
            which, four = bucket(h, n), (h & low).astype("<u4")
            rows = []
            for k, at in split_by(which, n):
                at = at[np.argsort(count[at], kind="stable")]
                rows.append((k, np.bincount(count[at], minlength=least + 1).astype("<u4").tobytes() + four[at].tobytes()))
            ks, blobs = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for i, j, data, offs in blocks(b.column(0), 1 << 20):
                h, text = anchors(data, offs)
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
                parts.append(_fold([(h[new], np.ones(int(new.sum()), np.uint8))], least))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            parts = []
            for _, blob in rows:
                counts = np.frombuffer(blob, "<u4", least + 1)
                parts.append((np.frombuffer(blob, "<u4", -1, 4 * (least + 1)), np.repeat(np.arange(least + 1, dtype=np.uint8), counts)))
            h, count = _fold(parts, least)
            yield pa.RecordBatch.from_arrays([pa.array(h[count >= least].astype(np.int64))], names=["slot"])

    dealt = texts.select("text").mapInArrow(giving_back(gather), "bucket int, blob binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return bitmap(written(dealt.mapInArrow(giving_back(meet), "slot long"), "shared"), bits)


def bitmap(slots: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The broadcast bitmap of the hashes in ``slot``, of which the lowest bits count."""
    spark = slots.sparkSession
    bits = min(bits, max(3, (slots.count() * LOAD).bit_length()))
    chunk = 1 << min(bits, 16)  # bits of one row of the bitmap

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column(0).to_numpy(zero_copy_only=False)
            which = slot // chunk
            for k, at in split_by(which, int(which.max()) + 1 if len(which) else 0):
                maps.setdefault(k, np.zeros(chunk, bool))[slot[at] % chunk] = True
        if maps:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(maps), pa.int64()), pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())],
                names=["k", "bits"],
            )

    full = np.zeros((1 << bits) // 8, np.uint8)
    low_bits = slots.select(F.col("slot").bitwiseAND((1 << bits) - 1).alias("slot"))
    packed = low_bits.repartitionByRange(max(1, min(16, partitions(spark))), "slot").mapInArrow(giving_back(pack), "k long, bits binary")
    for r in packed.toLocalIterator():  # at most 2^bits / 2^16 rows, and a few at the borders of ranges
        full[r[0] * chunk // 8 : (r[0] + 1) * chunk // 8] |= np.frombuffer(r[1], np.uint8)
    return Filter(bits, spark.sparkContext.broadcast(full))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket, as they come sorted by it."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield now, rows


def flags(window: np.ndarray, doc: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each entry: whether a smaller doc has an equal window. ``window`` has their hashes;
    ``equal`` tells for two arrays of entries which of the windows really are equal. What only
    shares its hash with the first of a run is looked at again without those that equal it."""
    out, left = np.zeros(len(window), bool), np.arange(len(window))
    while len(left):
        order = left[np.lexsort((doc[left], window[left]))]
        w = window[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        lead = np.repeat(order[first], np.diff(np.append(first, len(w))))
        same = order == lead
        others = np.flatnonzero(~same)
        same[others] = equal(order[others], lead[others])
        out[order] = same & (doc[order] > doc[lead])
        left = order[~same]
    return out


def ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Flagged starts (or ranges of them) as ``(doc, tag, start, size)``, ranges that touch as one, in order."""
    size = np.ones(len(start), np.int64) if size is None else size.astype(np.int64)
    order = np.lexsort((start, tag, doc))
    doc, tag, start, size = doc[order].astype("<i8"), tag[order].astype("<i8"), start[order].astype(np.int64), size[order]
    if not len(doc):
        return doc, tag, start.astype("<i4"), size.astype("<i4")
    end = start + size
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])]))
    end = np.maximum.reduceat(end, first)
    return doc[first], tag[first], start[first].astype("<i4"), (end - start[first]).astype("<i4")


def flag_blobs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: int, size: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """Flags packed by document bucket, one blob each: documents, their counts, all ranges of starts."""
    doc, tag, start, size = ranges(doc, tag, start, size)
    out = []
    for k, at in split_by(bucket(mix(doc.view(U)), n), n):
        d, t = doc[at], tag[at]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
        count = np.diff(np.append(first, len(d))).astype("<i4")
        head = np.array([len(first), len(d)], "<i4")
        out.append((k, b"".join(x.tobytes() for x in (head, d[first], t[first], count, start[at], size[at]))))
    return out


def _flags_of(blob: bytes) -> tuple[np.ndarray, ...]:
    d, n = np.frombuffer(blob, "<i4", 2).tolist()
    doc, tag, count = np.frombuffer(blob, "<i8", d, 8), np.frombuffer(blob, "<i8", d, 8 + 8 * d), np.frombuffer(blob, "<i4", d, 8 + 16 * d)
    start, size = np.frombuffer(blob, "<i4", n, 8 + 20 * d), np.frombuffer(blob, "<i4", n, 8 + 20 * d + 4 * n)
    return np.repeat(doc, count), np.repeat(tag, count), start, size


def packed_windows(h: np.ndarray, low: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> bytes:
    """Windows in document order: a short table of documents, then hashes and starts."""
    order = np.lexsort((start, tag, doc))
    h, low, doc, tag, start = h[order], low[order], doc[order], tag[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
    size = np.diff(np.append(first, len(doc)))
    head = np.array([len(first), len(h)], "<i8")
    parts = (head, doc[first].astype("<i8"), tag[first].astype("<i8"), h.astype("<u8"), low.astype("<u8"), start.astype("<i4"), size.astype("<i4"))
    return b"".join(x.tobytes() for x in parts)


def unpacked_windows(blob: bytes) -> tuple[np.ndarray, ...]:
    """Hashes (two halves), documents, tags and starts."""
    d, n = np.frombuffer(blob, "<i8", 2).tolist()
    at, out = 16, []
    for kind, count, width in (("<i8", d, 8), ("<i8", d, 8), ("<u8", n, 8), ("<u8", n, 8), ("<i4", n, 4), ("<i4", d, 4)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * width
    doc, tag, h, low, start, size = out
    return h, low, np.repeat(doc, size), np.repeat(tag, size), start


#: Rows between passes: kind 0 has windows still to be settled, kind 1 flags of a document bucket.
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
ROWS_DDL = "bucket int, kind int, blob binary"


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ROWS)], schema=ROWS)


def settle(rows: DataFrame, judge: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``(doc_id, tag, starts)``, one row a flagged document, from rows of ``ROWS``: ``judge``
    flags the windows of one bucket. Flags travel in blobs by document bucket, so that their
    number follows the tasks and not the documents times the tasks."""
    spark = rows.sparkSession
    n = partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            doc, tag, start, size = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
            got = flag_blobs(doc, tag, start, n, size)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["k", "blob"])

        parts: list[tuple[np.ndarray, ...]] = []
        for _, got in by_bucket(batches):
            parts += [_flags_of(r[2]) for r in got if r[1] == 1]
            open_ = [r[2] for r in got if r[1] == 0]
            if open_:
                parts.append(ranges(*judge(open_)))
            if sum(len(p[0]) for p in parts) >= 2 * FLUSH:
                yield out(parts)
                parts = []
        yield out(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in by_bucket(batches):
            doc, tag, start, size = ranges(*(np.concatenate(x) for x in zip(*(_flags_of(r[1]) for r in got))))
            pairs = np.stack([start, size], axis=1)
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
            ends = np.append(first[1:], len(doc))
            for i in range(0, len(first), 10_000):
                f, e = first[i : i + 10_000], ends[i : i + 10_000]
                starts = [pairs[x:y].tobytes() for x, y in zip(f.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[f], pa.int64()), pa.array(tag[f], pa.int64()), pa.array(starts, pa.binary())],
                    names=["doc_id", "tag", "starts"],
                )

    flagged = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(run), "k int, blob binary")
    return flagged.repartition(n, "k").sortWithinPartitions("k").mapInArrow(giving_back(gather), "doc_id long, tag long, starts binary")


def with_starts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, tag, text, ...``) with all their flagged starts, null where there are none."""
    return docs.join(found, ["doc_id", "tag"], "left")


def starts_of(blob: bytes | None) -> np.ndarray:
    """The starts in a document's ranges."""
    if not blob:
        return np.zeros(0, np.int64)
    start, size = np.frombuffer(blob, "<i4").reshape(-1, 2).astype(np.int64).T
    return np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
