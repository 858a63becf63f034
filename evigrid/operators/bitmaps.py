"""Pairs of owners that share keys, 64 at a time: bitmaps of who has a key, and sums of them kept bit by bit.

A part of the right owners has a column each. A key is a row of bits that says which of them have it, a
left owner's keys are added up into planes: bit ``c`` of plane ``k`` is bit ``k`` of what the pair counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Right owners and left owners that are worked at once, and the most bytes of the bits before they are packed.
WIDE, DEEP, MOST = 8192, 64, 1 << 25


def within(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group, in the order of the rows."""
    by = np.argsort(group, kind="stable")
    new = np.append(True, group[by][1:] != group[by][:-1])[: len(by)]
    first = np.flatnonzero(new)
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return out


def holders(key: np.ndarray, owner: np.ndarray, n_keys: int, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of ``owners`` and the bitmap of each key over a part; a last row has no bits."""
    place = np.full(int(max(owner.max(initial=0), owners.max(initial=0))) + 1, -1)
    place[owners] = np.arange(len(owners))
    at = place[owner]
    by = np.argsort(at, kind="stable")
    at, key = at[by], key[by]
    wide = max(64, min(WIDE, MOST // (n_keys + 1) // 64 * 64, -(-len(owners) // 64) * 64))
    for s in range(0, len(owners), wide):
        low, high = np.searchsorted(at, [s, s + wide])
        bits = np.zeros((n_keys + 1, wide), bool)
        bits[key[low:high], at[low:high] - s] = True
        yield owners[s : s + wide], np.packbits(bits, axis=1, bitorder="little").view(U)


class Segments:
    """Rows ``(owner, key)`` of left owners, in groups of ``order`` and in each of these by place, no owner twice."""

    def __init__(self, order: np.ndarray, owner: np.ndarray, key: np.ndarray, n: int) -> None:
        place = within(order * n + owner)
        by = np.lexsort((owner, place, order))
        order, place, owner, key = order[by], place[by], owner[by], key[by]
        cut = np.flatnonzero(np.append(True, (order[1:] != order[:-1]) | (place[1:] != place[:-1]))[: len(by)])
        self.groups: dict[int, list[tuple[np.ndarray | slice, np.ndarray]]] = {}
        for s, t in zip(cut.tolist(), np.append(cut[1:], len(by)).tolist()):
            # Owners 0, 1, 2, ... are a slice, which needs no copies.
            of = slice(0, t - s) if owner[t - 1] == t - s - 1 else owner[s:t]
            self.groups.setdefault(int(order[s]), []).append((of, key[s:t]))


class Sum:
    """Counts of ``n`` left owners by right owner, a plane for each bit."""

    def __init__(self, n: int, words: int) -> None:
        self.shape, self.planes = (n, words), []

    def add(self, x: np.ndarray, of: np.ndarray | slice = slice(None), bit: int = 0) -> None:
        """Adds ``2 ** bit`` for the owners ``of`` where ``x`` has bits."""
        while True:
            while len(self.planes) <= bit:
                self.planes.append(np.zeros(self.shape, U))
            s = self.planes[bit][of]
            carry = s & x
            if isinstance(of, slice):
                np.bitwise_xor(s, x, out=s)
            else:
                self.planes[bit][of] = s ^ x
            if not carry.any():
                return
            x, bit = carry, bit + 1

    def rows(self, segments: Segments, bits: np.ndarray, bit: int = 0) -> None:
        for places in segments.groups.values():
            for of, key in places:
                self.add(bits[key], of, bit)


def any_of(places: list[tuple[np.ndarray | slice, np.ndarray]], bits: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Which right owners have one of the keys of a group."""
    out = np.zeros(shape, U)
    for of, key in places:
        out[of] |= bits[key]
    return out


def numbers(planes: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Planes as numbers, a row for each left and a column for each right owner."""
    n, words = shape
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(planes) <= 8 * np.dtype(k).itemsize)
    out = np.zeros((n, 64 * words), kind)
    for k in range(0, len(planes), 8):
        rows = np.zeros((n, 8 * words, 8), np.uint8)
        for i, p in enumerate(planes[k : k + 8]):
            rows[:, :, i] = np.ascontiguousarray(p).view(np.uint8)
        x = rows.view(U)[:, :, 0]
        # Eight bytes are a square of bits, turned over so that each byte is a number.
        for by, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
            t = (x ^ (x >> U(by))) & U(mask)
            x = x ^ t ^ (t << U(by))
        part = x.view(np.uint8).reshape(n, 64 * words)
        out = part.copy() if kind is np.uint8 else out | (part.astype(kind) << kind(k))
    return out
