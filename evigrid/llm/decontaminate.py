"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items. A block is two words; the shift table says
by its hash how far the search may jump when the block ends the current position, suffix-hash
buckets give the few windows that end in such a block, and comparing the bytes confirms.
Items shorter than a window are patterns of their own length; each length has its own tables.
The tables are flat arrays over the text of the items, with a bound on their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks, giving_back
from evigrid.plans.lineage import written

#: Lower-cases A-Z and blanks everything but digits, letters and non-ASCII bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of built tables that are broadcast at once; a larger benchmark is searched in several passes.
MOST_BYTES = 64 << 20
#: Built bytes for each word besides its own: start, length and item of a window, 16 slots of shifts, 8 bytes of buckets.
PER_WORD = 36
#: Windows of an item that stay together; a longer item is cut into pieces that overlap by a window less a word.
PIECE = 4096


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Tables:
    """Shift and bucket tables for patterns of one length: ``data`` has the pieces, words joined by blanks."""

    width: int
    data: bytes
    items: list[str]
    shift: bytes
    bucket: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, width: int, pieces: list[tuple[str, bytes]]) -> Tables:
        """From ``(item, words joined by blanks)``."""
        items = sorted({i for i, _ in pieces})
        number = {i: k for k, i in enumerate(items)}
        block = min(2, width)
        at, data, starts, sizes, owner, ends, hashes, jumps = 0, [], [], [], [], [], [], []
        for item, text in pieces:
            words = text.split(b" ")
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            begin = at + np.cumsum(lengths + 1) - lengths - 1
            h = np.fromiter((crc32(b" ".join(words[j - block + 1 : j + 1])) for j in range(block - 1, len(words))), np.uint32, len(words) - block + 1)
            n = len(words) - width + 1
            starts.append(begin[:n])
            sizes.append(begin[width - 1 :] + lengths[width - 1 :] - begin[:n])
            owner.append(np.full(n, number[item]))
            ends.append(h[width - block :])
            hashes.append(h)
            # The first window with the block has it nearest to its end.
            jumps.append(np.maximum(width - block - np.arange(len(h)), 0))
            data.append(text + b" ")
            at += len(text) + 1
        hashes, jumps, ends = (np.concatenate(x) for x in (hashes, jumps, ends))
        shift = np.full(1 << max(4, int(8 * len(ends)).bit_length()), width - block + 1, np.uint8)
        np.minimum.at(shift, hashes & np.uint32(len(shift) - 1), jumps.astype(np.uint8))
        n = 1 << max(3, len(ends).bit_length())
        slot = ends & np.uint32(n - 1)
        order = np.argsort(slot, kind="stable")
        bucket = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=n))]).astype(np.uint32)
        start, size, item = (np.concatenate(x)[order].astype(np.uint32) for x in (starts, sizes, owner))
        return cls(width, b"".join(data), items, shift.tobytes(), bucket, start, size, item)

    @property
    def nbytes(self) -> int:
        return len(self.data) + len(self.shift) + sum(x.nbytes for x in (self.bucket, self.start, self.size, self.item))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """``(start, items)`` of every occurrence."""
        width, shift, mask, slots = self.width, self.shift, len(self.shift) - 1, len(self.bucket) - 2
        block, at, n = min(2, width), width, len(words)
        while at <= n:
            h = crc32(b" ".join(words[at - block : at]))
            jump = shift[h & mask]
            if jump:
                at += jump
                continue
            low, high = self.bucket[h & slots], self.bucket[(h & slots) + 1]
            if low < high:
                text = b" ".join(words[at - width : at])
                found = []
                for k in range(low, high):
                    s = self.start[k]
                    if self.size[k] == len(text) and self.data[s : int(s) + len(text)] == text:
                        found.append(self.items[self.item[k]])
                if found:
                    yield at - width, found
            at += 1


def build(pieces: list[tuple[str, int, bytes]]) -> list[Tables]:
    """Tables of ``(item, width, words joined by blanks)``, one set for each width."""
    by_width: dict[int, list[tuple[str, bytes]]] = {}
    for item, width, text in pieces:
        by_width.setdefault(width, []).append((item, text))
    return [Tables.of(w, by_width[w]) for w in sorted(by_width)]


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item, width, piece binary, built long)``: the words of every item in pieces of bounded
    size, and a bound on the bytes of their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = fold_words(text.encode())
                width = min(window, len(words))
                for i in range(0, len(words) - width + 1 if words else 0, PIECE):
                    part = words[i : i + PIECE + width - 1]
                    joined = b" ".join(part)
                    rows.append((item, width, joined, len(joined) + 1 + PER_WORD * len(part) + 256))
                if len(rows) >= 1000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["item", "width", "piece", "built"])

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return items.mapInArrow(giving_back(run), "item string, width int, piece binary, built long").distinct()


def _parts(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, int, bytes]]]:
    """The pieces in parts whose tables take at most ``most`` bytes (or one piece, of bounded size),
    a part at a time on the driver."""
    pieces = written(_pieces(benchmark, window), "pieces")
    total = pieces.agg(F.coalesce(F.sum("built"), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("item", "piece"), F.lit(n))
    while n > 1 and pieces.groupBy(part).agg(F.sum("built").alias("b"), F.count("*").alias("n")).where((F.col("b") > most) & (F.col("n") > 1)).limit(1).count():
        n += max(1, n // 4)
        part = F.pmod(F.xxhash64("item", "piece"), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1], bytes(r[2])) for r in pieces.where(part == k).select("item", "width", "piece").toLocalIterator()]


def occurrences(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = MOST_BYTES,
    text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Where windows of benchmark items occur in every text.

    Gives ``(*keep, text, n_words, starts array<int>, ends array<int>, items array<string>)``
    for each row of ``docs``: word ranges covered by windows (merged, in order) and the
    distinct ids of their items, sorted as strings. A null or empty text has no words; very
    long texts and items are searched whole; items that are null, or have no words, match
    nothing; a null item_id is not an item; repeated items with one id count once. Repeated
    rows give repeated results; an empty table of either kind gives no rows or no marks.

    Tables are broadcast in parts of at most ``most_bytes`` as built. Each further part is one
    more pass over the rows, which are written in between so that one part is held at a time.
    """
    spark = docs.sparkSession
    marks = "starts array<int>, ends array<int>, items array<string>"
    types = {c: docs.schema[c].dataType.simpleString() for c in (*keep, text_col)}
    out = docs.select(*keep, F.col(text_col).alias("text"))
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "text string, n_words long, " + marks
    k = len(keep)
    before = None
    for number, part in enumerate(_parts(benchmark, window, most_bytes)):
        if before is not None:
            out = written(out, "searched")
            before.unpersist()
        before = tables = spark.sparkContext.broadcast(build(part))

        def run(batches: Iterator[pa.RecordBatch], tables=tables, again=number > 0) -> Iterator[pa.RecordBatch]:
            machines = tables.value
            for b in batches:
                names = [*keep, "text", "n_words", "starts", "ends", "items"]
                for i, j, data, offs in blocks(b.column(k)):
                    raw, cut = data.tobytes(), offs.tolist()
                    n_words, starts, ends, found = [], [], [], []
                    for r in range(j - i):
                        words = fold_words(raw[cut[r] : cut[r + 1]])
                        mask, ids = None, set()
                        for t in machines:
                            for at, its in t.find(words):
                                mask = np.zeros(len(words), bool) if mask is None else mask
                                mask[at : at + t.width] = True
                                ids.update(its)
                        if again and len(b.column(k + 2)[i + r]):
                            mask = np.zeros(len(words), bool) if mask is None else mask
                            for x, y in zip(b.column(k + 2)[i + r].as_py(), b.column(k + 3)[i + r].as_py()):
                                mask[x:y] = True
                        names_found = ids | (set(b.column(k + 4)[i + r].as_py()) if again else set())
                        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if mask is not None else []
                        n_words.append(len(words))
                        starts.append(edges[::2])
                        ends.append(edges[1::2])
                        found.append(sorted(names_found))
                    ints = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).slice(i, j - i) for c in range(k + 1)), pa.array(n_words, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(found, pa.list_(pa.string()))],
                        names=names,
                    )

        out = out.mapInArrow(giving_back(run), schema)
    return out


def hit_words() -> Column:
    """Number of words in the marked ranges."""
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every document.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the items with
    occurring windows; the digest is that of their ids, sorted as strings and joined by
    commas. Cases as in ``occurrences``.
    """
    found = occurrences(docs, benchmark, window, **options)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; columns as they came.

    Names of ``docs`` that clash with the search's own are kept apart by position.
    """
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    text = f"c{docs.columns.index('text')}"
    kept = tuple(c for c in inner.columns if c != text)
    found = occurrences(inner, benchmark, window, text_col=text, keep=kept, **options).where(F.size("starts") == 0)
    return found.select(*(F.col("text" if f"c{i}" == text else f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
