"""Dedup of repeated byte strings: shards of suffixes that share a content-defined anchor.

Any string of ``width`` bytes holds ``width - K + 1`` substrings of K bytes; the one
with the least hash is its anchor, so equal strings have equal anchors wherever they
stand. The suffixes whose first ``width`` bytes have one anchor form a shard entry: a
run of neighbouring starts and the bytes they reach over. Entries with an anchor that
occurs in one document only are never moved. A task groups the suffixes of its shard by a
hash of their first ``width`` bytes, compares those bytes and settles each group of equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evigrid.llm import spans
from evigrid.llm.arrays import blocks, covered, mix, prefix_sums, span_hash

U = np.uint64
WIDTH = 50
K = 20
#: Starts and bytes that a map task settles at once; its arrays take some 100 bytes for each.
FLUSH, HELD = 1_000_000, 6 << 20
BLOCK = 1 << 20


def _runs(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``(anchor hash, text, first start, last start + 1)`` of each run of starts with one anchor,
    and the prefix sums of the block."""
    sums = prefix_sums(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return np.zeros(0, U), none, none, none, sums
    at = np.arange(n - K + 1)
    h = span_hash(sums, at, at + K)
    low = (h & U(0xFFFFFFFF00000000)) | at.astype(U)  # the least hash, and of equal ones the first
    span, have = width - K + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    start = np.arange(n - width + 1)
    text = np.searchsorted(offs, start, "right") - 1
    valid = start + width <= offs[text + 1]
    start, text, place = start[valid], text[valid], (low[valid] & U(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return np.zeros(0, U), none, none, none, sums
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    # Least hashes crowd at the low end; scrambled again they spread over the buckets.
    return mix(h[place[first]] ^ U(0x5851F42D4C957F2D)), text[first], start[first], start[last] + 1, sums


def minimizers(width: int):
    def run(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, text, *_ = _runs(data, offs, width)
        return h, text

    return run


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start of every run, and the number of its run."""
    size = last - first
    run = np.repeat(np.arange(len(size)), size)
    return first[run] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), run


def _again(data: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each start: whether the same ``width`` bytes start in a smaller doc."""
    if not len(start):
        return np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(data, width)

    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), bool)
        for i in range(0, len(x), 100_000):
            at = slice(i, i + 100_000)
            out[at] = (view[start[x[at]]] == view[start[y[at]]]).all(axis=1)
        return out

    return spans.flags(span_hash(prefix_sums(data), start, start + width), doc, equal)


def removable(docs: DataFrame, width: int = WIDTH, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``(doc_id, tag, starts)``: places of bytes where a string of ``width`` bytes starts that
    also starts in a document with a smaller id."""
    if width <= K:
        raise ValueError(f"strings need more than {K} bytes")
    n = spans.buckets_of(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL")
    bitmap = spans.shared_filter(docs, minimizers(width), bits)

    def settle_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            # Blocks end to end; runs are numbered over all of them.
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            data = np.concatenate([x[0] for x in held])
            anchor, doc, tag, origin = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
            first, last = (np.concatenate([x[k] + b for x, b in zip(held, base)]) for k in (5, 6))
            start, run = _spread(first, last)
            again = _again(data, start, doc[run], width)
            local = start - first[run] + origin[run]
            rows = [(k, 1, blob) for k, blob in spans.flag_blobs(doc[run][again], tag[run][again], local[again], n)]
            open_ = np.flatnonzero(np.bincount(run, ~again, len(first)) > 0)
            for k, at in spans.split_by(spans.bucket(anchor[open_], n), n):
                at = open_[at]
                place, _ = _spread(first[at], last[at] + width - 1)
                rows.append((k, 0, _packed(data[place], doc[at], tag[at], origin[at], last[at] - first[at])))
            return spans.rows_batch(rows)

        for b in batches:
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j, data, offs in blocks(b.column(2), BLOCK):
                anchor, text, first, last, _ = _runs(data, offs, width)
                keep = bitmap.marked(anchor)
                anchor, text, first, last = anchor[keep], text[keep], first[keep], last[keep]
                held.append((data, anchor, ids[i:j][text].astype(np.int64), tags[i:j][text].astype(np.int64), first - offs[text], first, last))
                if sum(len(x[0]) for x in held) >= HELD or sum(int((x[6] - x[5]).sum()) for x in held) >= FLUSH:
                    yield out()
                    held = []
        if held:
            yield out()

    def judge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, doc, tag, origin, size = (np.concatenate(x) for x in zip(*map(_unpacked, blobs)))
        ends = np.cumsum(size + width - 1)
        first = ends - (size + width - 1)
        start, run = _spread(first, first + size)
        again = _again(data, start, doc[run], width)
        return doc[run][again], tag[run][again], (start - first[run] + origin[run])[again]

    return spans.settle(docs.mapInArrow(settle_own, spans.ROWS_DDL), judge)


def _packed(data: np.ndarray, doc: np.ndarray, tag: np.ndarray, origin: np.ndarray, size: np.ndarray) -> bytes:
    """Entries with their bytes; a document's entries stand together, so that its id compresses."""
    raw = b"".join(x.tobytes() for x in (doc.astype("<i8"), tag.astype("<i8"), origin.astype("<i4"), size.astype("<i4"), data))
    return np.array([len(doc), len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n, length = np.frombuffer(blob, "<i8", 2).tolist()
    raw = pa.decompress(blob[16:], length, codec="zstd", asbytes=True)
    doc, tag = np.frombuffer(raw, "<i8", 2 * n).reshape(2, n)
    origin, size = np.frombuffer(raw, "<i4", 2 * n, 16 * n).reshape(2, n).astype(np.int64)
    return np.frombuffer(raw, np.uint8, -1, 24 * n), doc, tag, origin, size


def deduplicated(docs: DataFrame, width: int = WIDTH, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256)`` of every row.

    A byte goes if a string of ``width`` bytes covers it that also starts in a document
    with a smaller doc_id, judged on the input; ``n_spans`` counts the maximal removed
    runs. A null text is empty; texts shorter than ``width`` lose nothing; very long texts
    are treated whole, in a block of their own. Rows with a null doc_id lose nothing and
    take nothing. Repeated rows are treated alike and do not count against each other; rows
    that repeat a doc_id with another text are told apart by a 64-bit hash of the text. An
    empty table gives no rows. Ids may be of any type that has an order (see ``spans.numbered``).
    Other columns are not looked at.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column(2).to_pylist()
            for i, j, data, offs in blocks(b.column(1)):
                gone, runs, kept = [], [], []
                for r in range(j - i):
                    own = data[offs[r] : offs[r + 1]]
                    mask = covered(spans.starts_of(starts[i + r]), width, len(own)) if starts[i + r] else np.zeros(len(own), bool)
                    gone.append(int(mask.sum()))
                    runs.append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
                    kept.append(own[~mask].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    docs, named = spans.numbered(docs.select("doc_id", "text"))
    rows = spans.keyed(docs)
    found = spans.with_starts(rows, removable(rows, width, bits)).select("doc_id", "text", "starts")
    return named(found.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
