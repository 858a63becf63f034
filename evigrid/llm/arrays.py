"""Vectorised text kernels for Arrow batches: whole texts as one byte array with offsets.

All functions work on a *block*: ``data`` (uint8, the texts end to end) and
``offs`` (int64, n + 1 offsets). Nothing here knows about Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) >= n:
        return
    n = max(n, 1 << 16)
    inv = pow(int(_BASE), -1, 1 << 64)
    _powers, _inverse = (np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(n, b, U))]) for b in (_BASE, U(inv)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte range."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges; equal bytes have equal hashes wherever they stand.

    Unequal ones may too (certain regular strings of two letters do, from 1,024 bytes on): for
    callers that compare the bytes, or to whom a collision only means more work.
    """
    return mix((sums[end] - sums[start]) * _inverse[start])


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(width):
        out *= _BASE
        out += values[k : k + n]
    return mix(out)


def blocks(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, data, offs)`` with at most ``most`` bytes each, or one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, raw, data = texts.buffers()
    offs = np.frombuffer(raw, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def giving_back(run):
    """``run`` over the batches of a task, after which Arrow's pool returns what it holds: workers outlive
    their tasks, and those that wait count as memory of the executor like those that work."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return out


def table_of(pattern_bytes: bytes) -> np.ndarray:
    """True for the bytes that belong to a word."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern_bytes, np.uint8)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+`` in UTF-8.
PLAIN = table_of(bytes(b for b in range(256) if b != 0x20 and not 9 <= b <= 13))


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, text number)`` of every word; no word spans two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    is_word = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first half, second half, text number, place in the text)`` of every word: its XXH3 hash
    of 128 bits. Words are told apart byte by byte inside the block; each distinct one is hashed once."""
    start, end, text = words(data, offs)
    if not len(start):
        none = np.zeros(0, U)
        return none, none, text, text
    joined = data[PLAIN[data]]
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), U).reshape(-1, 2)
    return both[which, 0], both[which, 1], text, rank_in_text(text)


def rank_in_text(text: np.ndarray) -> np.ndarray:
    """Position of each word within its text; ``text`` is ascending."""
    if not len(text):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places covered by ``[start, start + width)``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
