"""Substring dedup over words with difference-cover anchors.

Anchors are short windows at cover positions, modulo a period. Any two equal long windows hold an
aligned pair of such anchors, equal ones. Hashes roll over a whole block at once; of them only
those at cover positions are looked up, and where an anchor is shared by two documents it is
extended to all long windows around it, which alone are moved and settled. They are dealt by their own hash and not by the anchor's, so that an anchor that
stands in a third of all rows, each time in other surroundings, fills no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm import spans
from evigrid.llm.arrays import blocks, covered, giving_back, rolling, word_hashes

#: Period and a set of residues such that any two places have a common shift, below the
#: period, that brings both into the set. A window of ``period - 1`` more words than an
#: anchor then holds an anchor of both its places.
PERIOD, COVER = 7, (0, 1, 3)
WIDTH = 13


def _anchor_mask(text: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(text) - size + 1)
    return (text[:n] == text[size - 1 :][:n]) & np.isin(place[:n] % PERIOD, COVER)


def cover_anchors(width: int):
    """Hashes of the windows of ``width - PERIOD + 1`` words at cover positions."""
    size = width - PERIOD + 1

    def run(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, _, text, place = word_hashes(data, offs)
        keep = _anchor_mask(text, place, size)
        return rolling(h, size)[keep], text[: len(keep)][keep]

    return run


def removable(docs: DataFrame, width: int = WIDTH, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``(doc_id, tag, starts)``: places of words where a window starts that also starts in a
    document with a smaller id.

    Windows are told apart by 128 bits of hash, two halves made from the halves of their words'
    XXH3: among the 2e13 words of 100 TB two different ones agree with probability 1e-12.
    """
    if width < PERIOD + 1:
        raise ValueError(f"windows need more than {PERIOD} words")
    spark = docs.sparkSession
    n = spans.buckets_of(spark)
    size = width - PERIOD + 1
    docs = docs.where("doc_id IS NOT NULL")
    bitmap = spans.shared_filter(docs, cover_anchors(width), bits)

    def settle_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h, low, doc, tag, start = (np.concatenate([x[k] for x in held]) for k in range(5))
            again = _again(h, low, doc)
            rows = [(k, 1, blob) for k, blob in spans.flag_blobs(doc[again], tag[again], start[again], n)]
            h, low, doc, tag, start = h[~again], low[~again], doc[~again], tag[~again], start[~again]
            for k, at in spans.split_by(spans.bucket(h, n), n):
                rows.append((k, 0, spans.packed_windows(h[at], low[at], doc[at], tag[at], start[at])))
            return spans.rows_batch(rows)

        for b in batches:
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, j, data, offs in blocks(b.column(2)):
                h, low, text, place = word_hashes(data, offs)
                hit = _anchor_mask(text, place, size)
                hit &= bitmap.marked(rolling(h, size))
                near = np.concatenate([[0], np.cumsum(hit)])
                full = rolling(h, width)
                s = np.arange(len(full))
                # A window holds an anchor if one starts at its first word or up to PERIOD - 1 words on.
                keep = (text[: len(full)] == text[width - 1 :][: len(full)]) & (near[np.minimum(s + PERIOD, len(hit))] > near[s])
                t = text[: len(full)][keep]
                held.append((full[keep], rolling(low, width)[keep], ids[i:j][t].astype(np.int64), tags[i:j][t].astype(np.int64), place[: len(full)][keep]))
                if sum(len(x[0]) for x in held) >= spans.FLUSH:
                    yield out()
                    held = []
        if held:
            yield out()

    return spans.settle(docs.mapInArrow(giving_back(settle_own), spans.ROWS_DDL), _judge)


def _again(h: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window: whether a smaller doc has it too."""
    return spans.flags(h, doc, lambda x, y: low[x] == low[y])


def _judge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, low, doc, tag, start = (np.concatenate(x) for x in zip(*map(spans.unpacked_windows, blobs)))
    again = _again(h, low, doc)
    return doc[again], tag[again], start[again]


def _as_text(found: list[bytes | None]) -> pa.Array:
    """Strings of these bytes, which need not be UTF-8."""
    return pa.array(found, pa.binary()).cast(pa.string(), safe=False)


def deduplicated(docs: DataFrame, width: int = WIDTH, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, kept_sha256)`` of every row.

    A word goes if a window of ``width`` words covers it whose words also start in a
    document with a smaller doc_id, judged on the input; kept words are joined by one
    space. A null text has no words; texts shorter than a window lose nothing. Rows with
    a null doc_id come before no other and after none: they lose nothing and take
    nothing. Repeated rows are treated alike and do not count against each other; rows
    that repeat a doc_id with another text are told apart by a 64-bit hash of the text.
    Very long texts are treated whole; an empty table gives no rows. Ids may be of any type
    that has an order (see ``spans.numbered``); bytes that are no UTF-8 are kept as they are.
    Other columns are not looked at.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column(2).to_pylist()
            for i, j, data, offs in blocks(b.column(1)):
                raw, cut = data.tobytes(), offs.tolist()
                total, gone, texts = [], [], []
                for r in range(j - i):
                    ws = raw[cut[r] : cut[r + 1]].split()
                    at = spans.starts_of(starts[i + r])
                    if len(at):
                        mask = covered(at, width, len(ws))
                        kept = [w for w, m in zip(ws, mask.tolist()) if not m]
                    else:
                        kept = ws
                    total.append(len(ws))
                    gone.append(len(ws) - len(kept))
                    texts.append(b" ".join(kept))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), _as_text(texts), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    docs, named = spans.numbered(docs.select("doc_id", "text"))
    rows = spans.keyed(docs)
    found = spans.with_starts(rows, removable(rows, width, bits)).select("doc_id", "text", "starts")
    return named(found.mapInArrow(giving_back(apply), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"))


def without_repeats(docs: DataFrame, width: int = WIDTH, bits: int = spans.FILTER_BITS) -> DataFrame:
    """``docs`` with repeated spans cut out of the texts; columns as they came.

    A text that loses nothing stays as it is, white space included; of the others the
    kept words are joined by one space (``n_chars``, if there, is counted again). A
    document that has no words left goes, unless it had none to begin with. Null doc_ids
    and repeated rows as in ``deduplicated``.
    """
    cols = docs.columns
    number, _ = spans.numbered(docs.select(*cols, F.col("doc_id").alias("_number")), "_number")
    rest = {c: f"c{i}" for i, c in enumerate(cols) if c != "text"}
    row = F.struct(F.lit(0), *(F.col(f"`{c}`").alias(name) for c, name in rest.items()))
    rows = number.select(F.col("_number").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text"), row.alias("row"))
    plain = rows.select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text"))
    found = spans.with_starts(rows, removable(plain, width, bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, kept = b.column(0), b.column(1).to_pylist(), []
            raw = texts.cast(pa.binary())
            for r, s in enumerate(starts):
                ws = (raw[r].as_py() or b"").split() if s else []
                mask = covered(spans.starts_of(s), width, len(ws)).tolist() if s else []
                kept.append(b" ".join(w for w, m in zip(ws, mask) if not m) if s else None)
            yield pa.RecordBatch.from_arrays([_as_text(kept), pa.array([bool(s) for s in starts], pa.bool_()), texts, b.column(2)], names=["kept", "cut", "text", "row"])

    ddl = f"kept string, cut boolean, text string, row {rows.schema['row'].dataType.simpleString()}"
    done = found.select("text", "starts", "row").mapInArrow(giving_back(cut), ddl).where("NOT cut OR kept <> ''")
    new = {"text": F.when(F.col("cut"), F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("cut"), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"row.{rest['n_chars']}"))
    return done.select(*((new[c] if c in new else F.col(f"row.{rest[c]}")).alias(c) for c in cols))
