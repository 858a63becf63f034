"""Byte-level BPE over batches: pre-tokens, a trie of the distinct ones, and their last tokens.

A text is cut into pre-tokens; equal ones (compared byte by byte) are encoded once. Their
prefixes form a trie, and what a prefix encodes to is known from its *last token* alone:
the encoding of a prefix is that of a shorter prefix plus one token, and just one token
fits (the merges would not join or split it with the token before). The trie is walked
depth first, in the order of the sorted words, and every node is solved once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Encodings that a task keeps from block to block, and the longest pre-token kept; beyond it starts afresh.
MEMORY, KEPT = 250_000, 64
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 9
#: Ranges in which this module's character classes are known to be the library's; texts with
#: other characters are cut by the library's own pre-tokenizer.
KNOWN = ((0x0, 0x557), (0x2000, 0x208E), (0x20A0, 0xA7CD), (0xAC00, 0xD7A3))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Pieces:
    """The pre-tokens of a block: ``distinct`` ones, and the number of the one (``word``) and
    of the text at each place, in text order."""

    word: np.ndarray
    text: np.ndarray
    distinct: list[bytes]


class Vocabulary:
    """A ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        to_byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        raw: list[bytes] = [b""] * size
        for piece, i in model["vocab"].items():
            raw[i] = bytes(to_byte[c] for c in piece)
        for content, i in self.special.items():
            raw[i] = content.encode()
        self.sizes = [len(x) for x in raw]
        self.lengths = np.array(self.sizes, np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.step: dict[tuple[int, int], int] = {}
        self.when, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for i, (a, b) in enumerate(merges):
            x, y, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.step.setdefault((x, y), i)
            if self.when[made] < 0:  # the earliest merge that makes a token is the one that does
                self.left[made], self.right[made], self.when[made] = x, y, i
        sound = [bool(x) and self.when[i] < 0 for i, x in enumerate(raw)]
        for t in sorted((t for t in range(size) if self.when[t] >= 0), key=self.when.__getitem__):
            x, y = self.left[t], self.right[t]
            sound[t] = sound[x] and sound[y] and self._apart(x, y, self.when[t])
        for i in self.special.values():
            sound[i] = False
        self.token = {raw[i]: i for i in range(size) if sound[i]}
        lengths = sorted({len(x) for x in self.token}, key=lambda k: (abs(k - 2.6), k))
        # Exactly one last token fits a prefix, so lengths may be tried in any order: likely ones first.
        self.tries = [[k for k in lengths if k <= end] for end in range(max(lengths) + 1)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = self._specials()
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        for low, high in KNOWN:
            chars = "".join(map(chr, range(low, high + 1)))
            self.kind[low : high + 1] = OTHER
            for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
                self.kind[[ord(c) for c in regex.findall(pattern, chars)]] = kind

    def _specials(self) -> dict[bytes, bytes]:
        """An ordinary pre-token never has the bytes of a special string: those are cut out before."""
        return {content.encode(): array("I", [i]).tobytes() for content, i in self.special.items()}

    def forget(self) -> None:
        """Gives up what blocks left, so that a worker that waits for its next task holds the vocabulary only."""
        self.known = self._specials()
        self.fits.clear()

    def _apart(self, a: int, b: int, before: int = 1 << 40) -> bool:
        """Whether tokens ``a`` and ``b`` stay side by side: no merge across their border comes
        before the merges that make them (and before step ``before``). Undoes the latest merge
        at the border again and again, and looks whether what meets there would have merged."""
        while True:
            if self.step.get((a, b), before) < before:
                return False
            x, y = self.when[a], self.when[b]
            if x < 0 and y < 0:
                return True
            # A merge at a place further left comes first among equal steps: on the right side
            # the border pair wins a tie with the merge that made b, on the left side it does not.
            if x > y:
                before, a = x, self.right[a]
            else:
                before, b = y + 1, self.left[b]

    def cuts(self, block: bytes, offs: np.ndarray) -> Pieces:
        """The pre-tokens of the texts of a block, as the library's pre-tokenizer makes them."""
        text_of_block = block.decode()
        chars = np.frombuffer(text_of_block.encode("utf-32-le"), np.uint32)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        edge = np.searchsorted(at, offs)
        n, kind = len(chars), self.kind[chars]
        odd = np.unique(np.searchsorted(edge, np.flatnonzero(kind == UNKNOWN), "right") - 1)
        if self.cut:
            low = text_of_block if any(s.encode() in block for s in self.special) else ""
            odd = np.union1d(odd, [np.searchsorted(edge, m.start(), "right") - 1 for m in self.cut.finditer(low)]).astype(np.int64)
        last = np.zeros(n + 1, bool)
        last[edge] = True
        first = last[:n].copy()
        prev = np.concatenate([[UNKNOWN], kind[:-1]]).astype(np.uint8) if n else kind
        start = first | (kind != prev)
        space = kind == SPACE
        nxt = np.concatenate([kind[1:], [UNKNOWN]]).astype(np.uint8) if n else kind
        # The last white space before a word stands alone; a blank goes with the word.
        tail = space & (nxt != SPACE) & ~last[1:]
        start |= tail
        glue = np.flatnonzero(tail & (chars == 32)) + 1
        start[glue] = False
        # Contractions: an apostrophe that starts a piece takes the letters of its ending.
        q = np.flatnonzero(start & (chars == 39))
        q = q[(q + 1 < n)]
        q = q[~first[q + 1]] if len(q) else q
        if len(q):
            pad = np.concatenate([chars, [0, 0]])
            one, two = pad[q + 1], pad[q + 2]
            two_ok = ~last[np.minimum(q + 2, n)] & (q + 2 < n)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = two_ok & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            take = np.where(short, 1, np.where(long, 2, 0))
            q, take = q[take > 0], take[take > 0]
            start[q + 1] = False
            after = q + 1 + take
            start[after[after < n]] = True
        begin = np.flatnonzero(start)
        text = np.searchsorted(edge, begin, "right") - 1
        bounds = np.append(at[begin], len(block)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(block)])
        if len(odd):
            ours = ~np.isin(text, odd)
            theirs = [(piece, t) for t in odd.tolist() for piece in self._slow(block[offs[t] : offs[t + 1]].decode())]
            pieces = pa.concat_arrays([pieces.filter(pa.array(ours)), pa.array([p for p, _ in theirs], pa.large_binary())])
            text = np.concatenate([text[ours], np.array([t for _, t in theirs], np.int64)])
        coded = pieces.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(odd):
            order = np.argsort(text, kind="stable")
            word, text = word[order], text[order]
        return Pieces(word, text, coded.dictionary.to_pylist())

    def _slow(self, text: str) -> Iterator[bytes]:
        """Pre-tokens from the library itself, around special strings."""
        at = 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            part = text[at : m.start() if m else len(text)]
            for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield part[i:j].encode()
            if m:
                yield m[0].encode()
                at = m.end()

    def _walk(self, words: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """For each of the sorted words the last token and the number of tokens of each prefix.

        The two lists are the path from the root of the trie to the word: what it shares with
        the word before stays, the rest is solved anew. They change with the next word.
        """
        token, fits, tries = self.token, self.fits, self.tries
        last, count, before = [-1], [0], b""
        for w in words:
            same = min(len(w), len(before))
            if w[:same] != before[:same]:
                same = next(i for i in range(same) if w[i] != before[i])
            del last[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                for k in tries[end] if end < len(tries) else tries[-1]:
                    t = token.get(w[end - k : end])
                    if t is None:
                        continue
                    if k == end:
                        break
                    pair = last[end - k], t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._apart(*pair)
                    if ok:
                        break
                else:
                    raise ValueError("a byte is missing in the vocabulary")
                last.append(t)
                count.append(count[end - k] + 1)
            before = w
            yield last, count
        if len(fits) > 4 * MEMORY:
            fits.clear()

    def counts(self, words: list[bytes]) -> list[int]:
        """Number of tokens of each of the distinct pre-tokens; no ids are made."""
        special = {s.encode() for s in self.special}
        order = sorted(set(words) - special)
        found = dict.fromkeys(special, 1)
        for w, (_, count) in zip(order, self._walk(order)):
            found[w] = count[len(w)]
        return [found[w] for w in words]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of the distinct pre-tokens."""
        known = self.known
        if len(known) > MEMORY:
            known = self.known = self._specials()
        new = sorted(w for w in words if w not in known)
        for w, (last, count) in zip(new, self._walk(new)):
            at, k = len(w), count[len(w)]
            out = array("I", bytes(4 * k))
            while at:
                k -= 1
                out[k] = last[at]
                at -= self.sizes[last[at]]
            known[w] = out.tobytes()
        parts = [known[w] for w in words]
        for w in new:
            if len(w) > KEPT:
                del known[w]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), np.uint32), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids, as the library's decoder turns them into text."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        out = self.bytes[np.repeat(self.starts[ids], size) + place].tobytes()
        cut = np.concatenate([[0], ends])[offs].tolist()
        return [out[i:j].decode(errors="replace").encode() for i, j in zip(cut, cut[1:])]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def as_ids(v: Vocabulary, p: Pieces, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, end to end, with offsets."""
    ids, offs = v.encode(p.distinct)
    size = np.diff(offs)[p.word]
    ends = np.cumsum(size)
    flat = np.repeat(offs[p.word] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    per_text = np.bincount(p.text, size, n_texts).astype(np.int64)
    return ids[flat], np.concatenate([[0], np.cumsum(per_text)])
