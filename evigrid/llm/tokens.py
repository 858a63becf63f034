"""Token counts, and BPE encoding and decoding, of whole texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks, giving_back
from evigrid.plans.lineage import partitions, written


def _ids_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


#: Bytes of text of which a map task counts the pre-tokens together, and of which it cuts them at once.
GROUP, CUT = 16 << 20, 4 << 20


def _packed(*arrays: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, compressed: small numbers take about a byte."""
    planes = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    head = np.array([len(planes), *(len(a) for a in arrays)], "<i8").tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(blob, "<i8", 1 + n).tolist()
    planes = pa.decompress(blob[8 + 8 * n :], size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum([0, *lengths]) * 4
    return [np.ascontiguousarray(np.frombuffer(planes[i:j], np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for i, j in zip(ends, ends[1:])]


class _Group:
    """Texts of a map task and the frequencies of their pre-tokens, numbered as they come."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.per_text: list[np.ndarray] = []
        self.bytes = 0

    def add(self, ids: pa.Array, offs: np.ndarray, p) -> None:
        number = np.array([self.number.setdefault(w, len(self.number)) for w in p.distinct], np.int64)
        key, times = np.unique((p.text << 32) | number[p.word], return_counts=True)
        self.ids.append(ids)
        self.sizes.append(np.diff(offs))
        self.words.append(key & 0xFFFFFFFF)
        self.times.append(times)
        self.per_text.append(np.bincount(key >> 32, minlength=len(ids)))
        self.bytes += int(offs[-1])

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """``(block, bucket, blob, ids, n_bytes)``: a row of pre-tokens for each bucket, and one (bucket -1)
        of the frequencies, in which pre-tokens are numbered by bucket and order in it."""
        pieces = list(self.number)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in pieces), np.int64, len(pieces))
        order = np.argsort(bucket, kind="stable")
        for k, at in ((k, order[i:j]) for k, i, j in _runs(bucket[order])):
            mine = [pieces[w] for w in at.tolist()]
            lengths = np.array([len(w) for w in mine])
            joined = b"".join(mine)
            head = _packed(lengths)
            yield block, k, np.array([len(head), len(joined)], "<i8").tobytes() + head + pa.compress(joined, codec="zstd", asbytes=True), None, None
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        per_text = np.concatenate(self.per_text)
        words, times = place[np.concatenate(self.words)], np.concatenate(self.times)
        by = np.lexsort((words, np.repeat(np.arange(len(per_text)), per_text)))
        words, times = words[by], times[by]
        first = (np.cumsum(per_text) - per_text)[per_text > 0]
        step = np.diff(words, prepend=0)
        step[first] = words[first]  # a text's numbers ascend; their steps are small
        yield block, -1, _packed(per_text, step, times), pa.concat_arrays(self.ids), np.concatenate(self.sizes)


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(key, start, end)`` of each run of equal keys."""
    if len(sorted_keys):
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        yield from zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist())


def _pieces(blob: bytes) -> list[bytes]:
    head, size = np.frombuffer(blob, "<i8", 2).tolist()
    (lengths,) = _unpacked(blob[16 : 16 + head], 1)
    joined = pa.decompress(blob[16 + head :], size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(lengths).tolist()
    return [joined[i:j] for i, j in zip([0, *ends], ends)]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: ``(doc_id, n_bytes, n_tokens, over_limit)``.

    Map tasks cut texts into pre-tokens and keep how often each stands in each text. The
    distinct pre-tokens meet in a task of their bucket, which counts the pieces of each once,
    whatever number of tasks have it; the counts go back and are joined to the frequencies,
    block by block, and summed. No ids are made, and no text is moved.

    A null or empty text has 0 bytes and 0 tokens. Very long texts are a block of their own;
    a pre-token of any length counts like any other. Repeated rows give repeated results, an
    empty table gives none, null ids pass through, other columns are not looked at.
    """
    kind, n = _ids_type(docs, id_col), partitions(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evigrid.llm.bpe import vocabulary

        v, group, done = vocabulary(vocabulary_path), _Group(), 0

        def out() -> Iterator[pa.RecordBatch]:
            block = (TaskContext.get().partitionId() << 32) | done
            for row in group.rows(block, n):
                ids = pa.array([None], pa.list_(id_type)) if row[3] is None else pa.ListArray.from_arrays(pa.array([0, len(row[3])], pa.int32()), row[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary()), ids, pa.array([row[4]], pa.list_(pa.int64()))],
                    names=["block", "bucket", "blob", "ids", "n_bytes"],
                )

        for b in batches:
            id_type = b.schema.types[0]
            for i, j, data, offs in blocks(b.column(1), CUT):
                group.add(b.column(0).slice(i, j - i), offs, v.cuts(data.tobytes(), offs))
                if group.bytes >= GROUP:
                    yield from out()
                    group, done = _Group(), done + 1
        if group.ids:
            yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evigrid.llm.bpe import vocabulary

        v, now, known = vocabulary(vocabulary_path), None, {}
        for b in batches:
            found = []
            for bucket, blob in zip(b.column(1).to_pylist(), b.column(2)):
                if bucket != now:
                    now, known = bucket, {}
                pieces = _pieces(blob.as_py())
                new = [w for w in pieces if w not in known]
                known.update(zip(new, v.counts(new)))
                found.append(_packed(np.array([known[w] for w in pieces])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["block", "bucket", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                parts = sorted(b.column("counts")[r].as_py() or [], key=lambda x: x["bucket"])
                counts = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x["counts"], 1)[0] for x in parts)])
                per_text, step, times = _unpacked(b.column("blob")[r].as_py(), 3)
                ends = np.concatenate([[0], np.cumsum(per_text)])
                run = np.cumsum(step)  # steps start anew with each text
                base = np.concatenate([[0], run])[ends[:-1]]
                sums = np.concatenate([[0], np.cumsum(counts[run - np.repeat(base, per_text)] * times)])
                tokens = sums[ends[1:]] - sums[ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[r].values, b.column("n_bytes")[r].values, pa.array(tokens), pa.array(tokens > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = written(docs.select(id_col, text_col).mapInArrow(cut, f"block long, bucket int, blob binary, ids array<{kind}>, n_bytes array<long>"), "frequencies")
    pieces = rows.where("bucket >= 0").select("block", "bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = pieces.mapInArrow(count, "block long, bucket int, counts binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("counts"))
    both = rows.where("bucket < 0").select("block", "blob", "ids", "n_bytes").join(counts, "block", "left")
    return both.select("blob", "ids", "n_bytes", "counts").mapInArrow(total, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def encoded(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ids of every text and what they decode to: ``(doc_id, *keep, ids array<int>, decoded)``.

    Encodes as the vocabulary's library does without added special tokens; special
    strings inside a text become their ids, and decode as themselves. ``decoded``
    is binary (UTF-8) and absent with ``decode=False``. A null or empty text has no
    ids; a very long text is encoded whole, in a block of its own. An empty table gives
    no rows. Repeated rows give repeated results; null ids pass through; ``keep`` names
    columns that are carried along, all others are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evigrid.llm.bpe import as_ids, vocabulary

        v = vocabulary(vocabulary_path)
        try:
            for b in batches:
                n = b.num_columns - 1
                for i, j, data, offs in blocks(b.column(n)):
                    ids, ends = as_ids(v, v.cuts(data.tobytes(), offs), j - i)
                    out = [b.column(k).slice(i, j - i) for k in range(n)]
                    out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    if decode:
                        out.append(pa.array(v.decode(ids, ends), pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:n], "ids", *["decoded"] * decode])
        finally:
            v.forget()

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    schema = kept + "ids array<int>" + ", decoded binary" * decode
    return docs.select(id_col, *keep, text_col).mapInArrow(giving_back(run), schema)


def round_trips(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encoded`` gives: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    Ids are digested as little-endian unsigned 32-bit integers, decoded texts as
    UTF-8, both inside the task that makes them. Nulls, empty texts and repeated
    rows as in ``encoded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evigrid.llm.bpe import as_ids, vocabulary

        v = vocabulary(vocabulary_path)
        try:
            for b in batches:
                for i, j, data, offs in blocks(b.column(1)):
                    ids, ends = as_ids(v, v.cuts(data.tobytes(), offs), j - i)
                    raw, cut = memoryview(ids.astype("<u4").tobytes()), (ends * 4).tolist()
                    a = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut, cut[1:])]
                    d = [hashlib.sha256(x).hexdigest() for x in v.decode(ids, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(a, pa.string()), pa.array(d, pa.string())],
                        names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            v.forget()

    schema = f"`{id_col}` {_ids_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(giving_back(_named(run, id_col)), schema)


def _named(run, id_col: str):
    """``run`` with its first column under the caller's name."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns([id_col, *b.schema.names[1:]])

    return out
