"""How the sources of a language differ in their vocabulary: pairs of sources and telling terms.

Two passes over the texts. The first cuts them into blocks and counts in how many documents of a
language each term occurs, exactly; terms of enough documents are kept. The second builds an
automaton for each block from the kept terms of that block, every one between delimiters, and
counts their occurrences in the block's texts by source. A block's automaton is bounded by its
own text, so that a vocabulary of any size needs no further pass and is never broadcast. What
comes of it, the postings (language, source, term, count), is sparse: shares of terms that a
source lacks are one number a source, and pairs are settled from sums over the postings.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks, table_of, words
from evigrid.llm.tokens import _packed, _unpacked
from evigrid.plans.lineage import partitions, written

#: Bytes of the words ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = table_of(bytes(b for b in range(256) if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
PAD = np.where(LETTERS, LOWER, 0x20).astype(np.uint8)
#: Bytes of text in a block, at most, or one longer text.
BLOCK = 4 << 20
SCALE = 1_000_000_000
LEAST_DOCS, MOST_TERMS = 3, 200
#: Sources whose pairs a task sums up in one matrix (8 MB).
TILE = 1024


def _named(docs: DataFrame, *more: str) -> DataFrame:
    """Language and source of every document (bytes that are no UTF-8 become U+FFFD), and more of it; nulls are empty."""
    text = lambda c: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit(""))
    return docs.select(*(F.make_valid_utf8(text(c)).alias(c) for c in ("lang", "source")), *(text(c).alias(c) for c in more))


def _bytes_of(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes, end to end, of an array that starts at its own beginning."""
    offs = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, terms.offset * 8) if len(terms) else np.zeros(1, np.int64)
    data = terms.buffers()[2] if len(terms) else None
    return np.diff(offs), memoryview(data)[offs[0] : offs[-1]].tobytes() if data is not None else b""


def _blob(terms: pa.LargeBinaryArray, *numbers: np.ndarray) -> bytes:
    """Terms and arrays of numbers below 2^32, packed."""
    lengths, joined = _bytes_of(terms)
    head = _packed(lengths, *numbers)
    return np.array([len(head), len(joined)], "<i8").tobytes() + head + pa.compress(joined, codec="zstd", asbytes=True)


def _open(blob: bytes, n: int) -> tuple[pa.LargeBinaryArray, list[np.ndarray]]:
    head, size = np.frombuffer(blob, "<i8", 2).tolist()
    lengths, *numbers = _unpacked(blob[16 : 16 + head], n + 1)
    joined = pa.decompress(blob[16 + head :], size, codec="zstd", asbytes=True) if size else b""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(joined)]), numbers


def _spans(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(key, start, end)`` of each run of equal keys, which ascend."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    yield from zip(keys[first].tolist() if len(keys) else [], list(first), [*list(first)[1:], len(keys)])


class _Block:
    """Texts that a map task counts together."""

    def __init__(self) -> None:
        self.langs, self.sources, self.texts, self.size = [], [], [], 0

    def terms(self, buckets: int) -> Iterator[tuple[int, list[str], bytes]]:
        """``(bucket, languages, blob)``: its distinct terms by language, with how many texts have each."""
        data, offs, lang, names = self._joined()
        start, end, text = words(data, offs, LETTERS)
        if not len(start):
            return
        bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[LETTERS[data]])]).dictionary_encode()
        which, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        each = np.unique(text * len(distinct) + which)  # a term once for each text
        key, docs = np.unique(lang[each // len(distinct)] * len(distinct) + each % len(distinct), return_counts=True)
        term, of = key % len(distinct), key // len(distinct)
        salts = [zlib.crc32(x.encode("utf-8", "surrogateescape")) for x in names]
        pieces = distinct.to_pylist()
        bucket = np.fromiter((zlib.crc32(pieces[t], salts[x]) % buckets for t, x in zip(term.tolist(), of.tolist())), np.int64, len(key))
        rank = np.empty(len(distinct), np.int64)
        rank[pc.sort_indices(distinct).to_numpy()] = np.arange(len(distinct))
        order = np.lexsort((rank[term], of, bucket))
        sorted_terms, of, docs = distinct.take(pa.array(term[order])), of[order], docs[order]
        for k, i, j in _spans(bucket[order]):
            yield k, names, _blob(sorted_terms.slice(i, j - i), of[i:j], docs[i:j])

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        offs = np.concatenate([[0], np.cumsum([len(x) for x in self.texts])]).astype(np.int64)
        names = {x: i for i, x in enumerate(dict.fromkeys(self.langs))}
        return PAD[np.frombuffer(b"".join(self.texts), np.uint8)], offs, np.array([names[x] for x in self.langs], np.int64), list(names)

    def padded(self) -> tuple[list[str], list[str], list[int], bytes]:
        """Languages, sources and sizes of the padded texts of each (language, source), and these end to end."""
        data, offs, _, _ = self._joined()
        raw, groups = data.tobytes(), {}
        for i, key in enumerate(zip(self.langs, self.sources)):
            groups.setdefault(key, []).append(raw[offs[i] : offs[i + 1]])
        parts = [b" " + b" ".join(v) + b" " for v in groups.values()]
        return [k[0] for k in groups], [k[1] for k in groups], [len(x) for x in parts], pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks, written: a row ``(block, bucket, langs, blob)`` of terms for each bucket, and one of the texts
    (bucket -1) with ``sources`` and ``sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), TaskContext.get().partitionId() << 33

        def out() -> Iterator[pa.RecordBatch]:
            for k, names, blob in block.terms(buckets):
                yield _row(TEXT_ROW, number, k, names, None, None, blob)
            langs, sources, sizes, blob = block.padded()
            yield _row(TEXT_ROW, number, -1, langs, sources, sizes, blob)

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, data, offs in blocks(b.column(2), BLOCK):
                if block.langs and block.size + len(data) > BLOCK:
                    yield from out()
                    block, number = _Block(), number + 1
                block.langs += langs[i:j]
                block.sources += sources[i:j]
                block.texts += [data[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:])]
                block.size += len(data)
        if block.langs:
            yield from out()

    schema = "block long, bucket int, langs array<string>, sources array<string>, sizes array<long>, blob binary"
    return written(_named(docs, "text").mapInArrow(run, schema), "blocks")


TEXT_ROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])
TERM_ROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("blob", pa.binary())])
COUNT_ROW = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("blob", pa.binary())])
POST_ROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("total", pa.int64()), ("tid", pa.int64()), ("v", pa.int64())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket; they come sorted."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if now is not None and r["bucket"] != now:
                yield now, rows
                rows = []
            now = r["bucket"]
            rows.append(r)
    if rows:
        yield now, rows


def _told_apart(rows: list[dict], n: int) -> tuple[list[str], pa.LargeBinaryArray, np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Of the blobs of a bucket: languages; distinct terms and the language of each; for every term of every
    blob, end to end, which of these it is; the blobs' numbers."""
    names: dict[str, int] = {}
    parts, of, numbers = [], [], []
    for r in rows:
        terms, more = _open(r["blob"], n)
        own = np.array([names.setdefault(x, len(names)) for x in r["langs"]], np.int64)
        parts.append(terms)
        of.append(own[more[0]])
        numbers.append(more)
    coded = pa.concat_arrays(parts).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, which = np.unique(np.concatenate(of) * len(coded.dictionary) + code, return_inverse=True)
    return list(names), coded.dictionary.take(pa.array(key % len(coded.dictionary))), key // len(coded.dictionary), which, numbers


def _kept(cut: DataFrame, buckets: int, least_docs: int) -> DataFrame:
    """``(block, bucket, langs, blob)``: of every blob of terms those that enough documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            _, _, _, which, numbers = _told_apart(rows, 2)
            docs = np.bincount(which, np.concatenate([x[1] for x in numbers]))  # whole numbers far below 2^53
            keep, at = docs[which] >= least_docs, 0
            for r, (of, _) in zip(rows, numbers):
                mine = np.flatnonzero(keep[at : at + len(of)])
                at += len(of)
                if len(mine):
                    terms, _ = _open(r["blob"], 2)
                    yield _row(TERM_ROW, r["block"], bucket, r["langs"], _blob(terms.take(pa.array(mine)), of[mine]))

    terms = cut.where("bucket >= 0").select("block", "bucket", "langs", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return terms.mapInArrow(run, "block long, bucket int, langs array<string>, blob binary")


def _counted(cut: DataFrame, kept: DataFrame) -> DataFrame:
    """``(bucket, langs, sources, blob)``: how often each kept term of a block occurs in it, by source, as its
    automaton finds them between delimiters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for b in batches:
            for r in range(b.num_rows):
                langs, sources, sizes, blob, parts = (b.column(c)[r].as_py() for c in ("langs", "sources", "sizes", "blob", "parts"))
                parts = sorted(parts, key=itemgetter("bucket"))
                opened = [_open(x["blob"], 1) for x in parts]
                terms = pa.concat_arrays([x[0] for x in opened])
                of = [x["langs"][i] for x, y in zip(parts, opened) for i in y[1][0].tolist()]
                kept: dict[str, ahocorasick.Automaton] = {}
                for k, (lang, t) in enumerate(zip(of, terms.to_pylist())):
                    if lang not in kept:
                        kept[lang] = ahocorasick.Automaton()
                    kept[lang].add_word(f" {t.decode('utf-8', 'surrogateescape')} ", k)
                for x in kept.values():
                    x.make_automaton()
                padded = pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True)
                names = {x: i for i, x in enumerate(dict.fromkeys(sources))}
                ends = np.cumsum(sizes).tolist()
                found = [np.zeros((3, 0), np.int64)]
                for lang, source, i, j in zip(langs, sources, [0, *ends], ends):
                    if lang in kept:
                        seen = Counter(map(itemgetter(1), kept[lang].iter(padded[i:j].decode("utf-8", "surrogateescape"))))
                        n = len(seen)
                        found.append(np.array([np.fromiter(seen, np.int64, n), np.full(n, names[source]), np.fromiter(seen.values(), np.int64, n)]))
                term, source, count = (x := np.concatenate(found, 1))[:, np.lexsort((x[1], x[0]))]
                at = 0
                for part, (own, (lang_of,)) in zip(parts, opened):
                    i, j = np.searchsorted(term, (at, at + len(own)))
                    entries = np.bincount(term[i:j] - at, minlength=len(own))
                    yield _row(COUNT_ROW, part["bucket"], part["langs"], list(names), _blob(own, lang_of, entries, source[i:j], count[i:j]))
                    at += len(own)

    parts = kept.groupBy("block").agg(F.collect_list(F.struct("bucket", "langs", "blob")).alias("parts"))
    texts = cut.where("bucket < 0").select("block", "langs", "sources", "sizes", "blob")
    both = texts.join(parts, "block").select("langs", "sources", "sizes", "blob", "parts")
    return both.mapInArrow(run, "bucket int, langs array<string>, sources array<string>, blob binary")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, term, count, total, tid, v)``: occurrences of kept terms by source and in the language;
    ``tid`` numbers (language, term), and ``v`` is 1 in one row of each. Terms are binary (UTF-8).

    Terms travel in blobs by bucket of (language, term), so that a frequent one is in one blob of
    each block; a bucket's blobs are told apart term by term, byte by byte.
    """
    buckets = partitions(docs.sparkSession)
    cut = _cut(docs, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            langs, terms, of, which, numbers = _told_apart(rows, 4)
            names: dict[str, int] = {}
            at, pairs = 0, []
            for r, (lang_of, entries, source, count) in zip(rows, numbers):
                own = np.array([names.setdefault(x, len(names)) for x in r["sources"]], np.int64)
                pairs.append((np.repeat(which[at : at + len(lang_of)], entries), own[source], count))
                at += len(lang_of)
            term, source, count = (np.concatenate([x[k] for x in pairs]) for k in range(3))
            key, same = np.unique(term * len(names) + source, return_inverse=True)
            n = np.bincount(same, count).astype(np.int64)
            term, source = key // len(names), key % len(names)
            total = np.bincount(term, n, len(terms)).astype(np.int64)
            first = np.concatenate([[True], term[1:] != term[:-1]]).astype(np.int64)
            for i in range(0, len(key), 100_000):
                t, x = term[i : i + 100_000], source[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(pa.array(of[t])), pa.array(list(names), pa.string()).take(pa.array(x)), terms.take(pa.array(t)).cast(pa.binary()),
                     pa.array(n[i : i + 100_000]), pa.array(total[t]), pa.array((bucket << 40) + t), pa.array(first[i : i + 100_000])],
                    schema=POST_ROW,
                )

    counted = _counted(cut, _kept(cut, buckets, least_docs)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return written(counted.mapInArrow(run, "lang string, source string, term binary, count long, total long, tid long, v long"), "postings")


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def share(count: Column | str, total: str, v: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + v)), in whole numbers."""
    over = F.call_function("div", _wide(F.lit(SCALE)) * _wide(_wide(count) + 1), _wide(F.col(total) + F.col(v)))
    return over.cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(dealt: DataFrame) -> DataFrame:
    """``(lang, a, b, v)``: over the terms that both sources have, what these add to the pair beyond what
    either of them alone adds. Terms come sorted; a task keeps one matrix of at most ``TILE`` squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, rest = None, None, None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            n, (lang, a, b) = len(at), now
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(a * TILE + at // TILE, pa.int64()), pa.array(b * TILE + at % TILE, pa.int64()), pa.array(total[at], pa.int64())],
                names=["lang", "a", "b", "v"],
            )

        def add(side, idx, p, p0, bounds) -> None:
            """Pairs of postings of equal terms; ``bounds`` are the ends of the terms."""
            size = np.diff(bounds)
            for i, j in _pieces(size, 1 << 20):
                lo, hi = bounds[i], bounds[j]
                n = size[i:j]
                first = np.repeat(np.repeat(bounds[i:j], n), np.repeat(n, n))
                x = np.repeat(np.arange(lo, hi), np.repeat(n, n))
                y = first + np.arange(len(x)) - np.repeat(np.cumsum(np.repeat(n, n)) - np.repeat(n, n), np.repeat(n, n))
                use = (side[x] & 1 > 0) & (side[y] & 2 > 0) & (x != y)
                x, y = x[use], y[use]
                f = lambda u, v: (u - v) ** 2 // v
                more = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
                np.add.at(total, (idx[x] % TILE) * TILE + idx[y] % TILE, more)

        for b in chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
            if rest is None or not rest.num_rows:
                continue
            keys, rest = _whole(rest, b is None)
            for key, part in keys:
                if key != now:
                    if now:
                        yield out()
                    now, total = key, np.zeros(TILE * TILE, np.int64)
                add(*part)
        if now:
            yield out()

    return dealt.mapInArrow(run, "lang string, a long, b long, v long")


def _pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of terms with at most so many pairs, or one term."""
    pairs, i = np.cumsum(size**2), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(pairs, (pairs[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _whole(t: pa.Table, last: bool = False) -> tuple[list, pa.Table]:
    """The rows of terms that are complete, as ``((lang, a, b), (side, idx, p, p0, bounds))``; and the rest."""
    n = t.num_rows
    cols = {c: t.column(c).combine_chunks() for c in t.column_names}
    new = np.ones(n, bool)
    for c in ("lang", "ta", "tb", "tid"):
        codes = cols[c].dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] = codes[1:] != codes[:-1] if c == "lang" else new[1:] | (codes[1:] != codes[:-1])
    starts = np.flatnonzero(new)
    end = n if last else int(starts[-1])
    if end == 0:
        return [], t
    starts = starts[starts < end]
    numbers = [cols[c].to_numpy(zero_copy_only=False)[:end] for c in ("side", "idx", "p", "p0")]
    keys = list(zip(*(cols[c].take(pa.array(starts)).to_pylist() for c in ("lang", "ta", "tb"))))
    out, i = [], 0
    while i < len(keys):
        j = i
        while j < len(keys) and keys[j] == keys[i]:
            j += 1
        lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else end
        out.append((keys[i], (*(x[lo:hi] for x in numbers), np.append(starts[i:j], hi) - lo)))
        i = j
    return out, t.slice(end)


#: Groups (language, source) that are broadcast, at most; beyond, joins on them are shuffled.
MOST_GROUPS = 10_000


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from each other one
    (``pair``), and the terms it uses more than its language does (``term``, the first ``most_terms``).

    ``docs`` needs ``lang``, ``source`` and ``text``; nulls are empty, other columns are not looked at.
    Sums are whole numbers throughout. Equal values rank by item. Repeated rows are documents of their
    own. Empty texts have no terms, but their group is there; very long texts are a block of their
    own. Where a language keeps no term, its pairs are 0 apart. An empty table gives none. A language
    with S sources has S(S - 1) pairs, which is the question; their sums are made in squares of
    ``TILE`` sources.
    """
    counts = postings(docs, least_docs)
    v = counts.groupBy("lang").agg(F.sum("v").alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    own = _named(docs).distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["n", "v"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    known = F.when(F.col("v") > 0, share(F.lit(0), "n", "v"))
    groups = written(own.select("lang", "source", "n", "v", place.alias("idx"), known.alias("p0")), "groups")
    few = groups.count() <= MOST_GROUPS
    hint = F.broadcast if few else (lambda df: df)
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.max("idx").alias("last"))
    with_group = counts.drop("v").join(hint(groups.join(of_lang, "lang")), ["lang", "source"])
    scored = written(with_group.select("lang", "source", "idx", "last", "tid", "term", share("count", "n", "v").alias("p"), share("total", "all", "v").alias("q"), "p0"), "scored")

    telling = scored.where("p > q")
    telling = telling.select("lang", "source", F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)

    a, b = groups.select("lang", F.col("idx").alias("a"), F.col("p0").alias("a0"), "v"), groups.select("lang", F.col("idx").alias("b"), F.col("p0").alias("b0"))
    other, none = F.col("a") != F.col("b"), apart(F.col("a0"), F.col("b0"))
    wide = lambda c: c.cast("decimal(38,0)")
    base = a.join(hint(b), "lang").where(other).select("lang", "a", "b", F.coalesce(wide(F.col("v")) * wide(none), wide(F.lit(0))).alias("v"))
    rows = scored.groupBy("lang", "idx", "p0", "p").agg(F.count("*").alias("n"))
    left = rows.select("lang", F.col("idx").alias("a"), F.col("p0").alias("a0"), "p", "n").join(hint(b), "lang").where(other)
    right = rows.select("lang", F.col("idx").alias("b"), F.col("p0").alias("b0"), "p", "n").join(hint(a.drop("v")), "lang").where(other)
    alone = lambda df, f: df.select("lang", "a", "b", (wide(F.col("n")) * wide(f - none)).cast("decimal(38,0)").alias("v"))
    tile, tiles = F.expr(f"idx div {TILE}"), F.expr(f"last div {TILE}")
    posts = scored.select("lang", "tid", "idx", "p", "p0", tile.alias("tile"), F.explode(F.sequence(F.lit(0), tiles)).alias("o"))
    ways = F.array(F.struct(F.col("tile").alias("ta"), F.col("o").alias("tb"), F.when(F.col("tile") == F.col("o"), 3).otherwise(1).alias("side")), F.struct(F.col("o").alias("ta"), F.col("tile").alias("tb"), F.when(F.col("tile") == F.col("o"), 0).otherwise(2).alias("side")))
    dealt = posts.select("lang", "tid", "idx", "p", "p0", F.inline(ways)).where("side > 0")
    dealt = dealt.repartition(partitions(docs.sparkSession), "lang", "ta", "tb", "tid").sortWithinPartitions("lang", "ta", "tb", "tid")
    both = _shared(dealt).select("lang", "a", "b", wide(F.col("v")).alias("v"))
    sums = base.unionByName(alone(left, apart(F.col("p"), F.col("b0")))).unionByName(alone(right, apart(F.col("a0"), F.col("p")))).unionByName(both)
    value = sums.groupBy("lang", "a", "b").agg(F.sum("v").cast("long").alias("value"))
    one, two = groups.select("lang", F.col("idx").alias("a"), "source"), groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"))
    pairs = value.join(hint(one), ["lang", "a"]).join(hint(two), ["lang", "b"]).select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))
