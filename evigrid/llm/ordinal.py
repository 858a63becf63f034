"""A quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - w.x)`` with one weight vector for all grades
and ordered thresholds. ``x`` marks which hashed words a text has, and in which band
its shape (symbols, echoes, word length) lies. It is fitted on a bounded sample of
the rated documents; scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.llm.arrays import blocks, mix, prefix_sums, span_hash, table_of, words

U = np.uint64
BITS = 18
#: Rated documents that the fit reads at most; those with the least hashed ids.
MOST_RATED = 8000
ROUNDS, L1, L2 = 300, 1e-4, 1e-5
#: Bytes of words here: digits, letters (A-Z folded) and everything that is not ASCII.
MEMBER = table_of(bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SYMBOLS = table_of(b"#*$%&|<>")
BANDS = 12


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)``, distinct and in order, of the texts of a block."""
    n = len(offs) - 1
    low = FOLD[data]
    start, end, text = words(low, offs, MEMBER)
    h = span_hash(prefix_sums(low), start, end)
    count = np.maximum(np.bincount(text, minlength=n), 1)
    echo = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1]))
    size = np.maximum(np.diff(offs), 1)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    shapes = ((symbols[offs[1:]] - symbols[offs[:-1]]) / size * 4, np.bincount(text[echo], minlength=n) / count, size / count / 20)
    which, feature = [text], [(h >> U(64 - BITS)).astype(np.int64)]
    for k, value in enumerate(shapes):
        band = np.minimum((value * BANDS).astype(np.int64), BANDS - 1)
        which.append(np.arange(n))
        feature.append((mix((band + 1000 * (k + 1)).astype(U)) >> U(64 - BITS)).astype(np.int64))
    key = np.unique((np.concatenate(which) << BITS) | np.concatenate(feature))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row a text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def fit(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS, l1: float = L1, l2: float = L2) -> Model:
    """Accelerated proximal gradient on the mean negative log-likelihood."""
    n = len(grade)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]) if n else np.linspace(0.3, 0.7, grades - 1)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-6 * np.arange(grades - 1))
    w = np.zeros(1 << BITS)
    if not n:
        return Model(w, t)
    seen = np.bincount(feature, minlength=1 << BITS)
    scale = 1 / np.sqrt(1 + seen / n * 50)  # common words say little; their columns are shrunk
    value = scale[feature]
    step = 4.0 / max(1.0, float(np.bincount(text, value**2, n).mean()))
    # Thresholds as a first one and positive gaps keep their order.
    free = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    last, momentum, now = w.copy(), 1.0, w.copy()
    for _ in range(rounds):
        t = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(text, now[feature] * value, n)
        edge = np.concatenate([[-30.0], t, [30.0]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[grade + d] - s, -30, 30))) for d in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        g = np.bincount(feature, (dhi - dlo)[text] * value, 1 << BITS) + l2 * now
        gt = np.array([dlo[grade == k + 1].sum() - dhi[grade == k].sum() for k in range(grades - 1)])
        gfree = np.concatenate([[gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(free[1:])])
        free = free - np.clip(2.0 * gfree / np.concatenate([[1.0], np.maximum(1.0, np.exp(2 * free[1:]))]), -0.1, 0.1)
        new = now - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        now = new + (momentum - 1) / after * (new - last)
        last, momentum = new, after
    return Model(last * scale, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 good. Of several ratings the lowest counts;
    rows with a null are left out."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(g).alias("grade"))


def fitted(docs: DataFrame, ratings: DataFrame, grades: int = 3, most_rated: int = MOST_RATED) -> Model:
    """The model of at most ``most_rated`` rated documents. The sample's features, not its
    texts, come to the driver: they are bounded by it. Ids may be of any type; of rows that
    repeat an id the least text counts (nulls last)."""
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                text, feature = features(data, offs)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))],
                    names=["doc_id", "grade", "features"],
                )

    # The chosen ids are at most most_rated rows of 12 bytes.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "text", "grade").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, features array<int>")
    got = rows.toArrow().sort_by("doc_id").combine_chunks()
    lists = got.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy().astype(np.int64) if len(got) else np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(got)), size), feature, got.column("grade").to_numpy().astype(np.int64), grades)


def scored(docs: DataFrame, model: Model, target: int = 2, cutoff: float = 0.4) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, kept)`` of every row.

    ``tail_probability`` is P(grade >= target); a row is kept from ``cutoff`` on. A null
    or empty text has no words and the shape of an empty text; very long texts are read
    whole. Repeated rows are scored alike; an empty table gives no rows; null ids pass
    through; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j, data, offs in blocks(b.column(1)):
                text, feature = features(data, offs)
                above = m.above(np.bincount(text, m.weights[feature], j - i))
                tail = above[:, target - 1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.round(above.sum(axis=1), 6)), pa.array(np.round(tail, 6)), pa.array(tail >= cutoff)],
                    names=["doc_id", "expected_grade", "tail_probability", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")
