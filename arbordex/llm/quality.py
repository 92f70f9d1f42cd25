"""Quality by ordinal cumulative-link regression (operator 5).

Ratings are graded: 0 poor (quality 0), 1 fair (quality 1, toxic 1), 2 good (quality 1, not toxic). One weight vector
over hashed text features is shared by all grades; ordered thresholds cut its score: P(grade > k) = logistic(w.x -
theta_k), theta_0 < theta_1 < ... by construction (each is the one before plus an exponential). The model gives the
expected grade and the tail probability P(grade >= keep_grade) by which documents are selected.

Features are hashed in numpy over whole texts: words, word shapes (runs of character classes, so that "THE!!" and
"TION!!" are alike), repeats of the word before, and the length. The model is fitted on the driver by AdaGrad on a
bounded sample: at most MAX_ROWS labelled rows of the training fold, those of the smallest hash of the id, with at most
MAX_FEATURES features of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm import _hashing as H
from arbordex.llm._common import small_batches, table

MAX_ROWS = 6000
#: Features of a row that are fitted: those of the largest values. With MAX_ROWS, a bound of what the driver gathers (8 bytes each).
MAX_FEATURES = 4096
BITS = 16
EPOCHS = 12
GRADES = 3

_CLASS = np.full(256, 5, dtype=np.uint8)  # bytes of letters beyond ASCII
_CLASS[:128] = np.arange(128)  # punctuation stands for itself
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[H.IS_SPACE] = 4
_CLASS[128:] = 3


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: (columns, values, offsets by document); rows have length 1, empty texts none but bias."""
    raw, offsets = H.text_bytes(column)
    low = H.LOWER_AZ[raw]
    start, end, first = H.words(low, offsets)
    word = H.span_hash(H.prefix_hash(low), start, end)
    kind = _CLASS[raw]
    change = np.ones(len(raw), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    at = np.concatenate(([0], np.cumsum(change)))
    shape = H.span_hash(H.prefix_hash(kind[change]), at[start], at[end])
    again = np.zeros(len(word), dtype=bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False  # not across documents
    salts = [np.uint64(11), np.uint64(22), np.uint64(33), np.uint64(44)]
    cols, vals, sizes = [], [], []
    mask = np.uint64((1 << bits) - 1)
    for f, t in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = t - f
        share = np.uint64(np.floor(10 * np.count_nonzero(again[f:t]) / n)) if n else np.uint64(0)
        single = H.mix(np.array([salts[2] * np.uint64(1000) + np.uint64(min(15, int(n).bit_length())), salts[3] * np.uint64(1000) + share], np.uint64))
        w, wc = np.unique(H.mix(word[f:t] + salts[0]) & mask, return_counts=True)
        s, sc = np.unique(H.mix(shape[f:t] + salts[1]) & mask, return_counts=True)
        wv, sv = np.log1p(wc), np.log1p(sc)
        wv, sv = wv / max(np.sqrt((wv**2).sum()), 1e-9), sv / max(np.sqrt((sv**2).sum()), 1e-9)
        cols += [w, s, single & mask]
        vals += [wv, sv, np.full(2, 0.5)]
        sizes.append(len(w) + len(s) + 2)
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate(cols).astype(np.int64), np.concatenate(vals), np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Ordinal:
    """weights over 2**bits features; thresholds in rising order, one fewer than the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def fit(cols: np.ndarray, vals: np.ndarray, offsets: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-5) -> Ordinal:
    """Maximum likelihood by mini-batch AdaGrad. Thresholds: a first one and logarithms of the gaps."""
    n, k = len(grades), n_grades - 1
    w, g2 = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    a, ga = np.concatenate(([-1.0], np.zeros(k - 1))), np.full(k, 1e-8)
    random = np.random.default_rng(5)
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, 32):
            rows = order[at : at + 32]
            spans = [np.arange(offsets[r], offsets[r + 1]) for r in rows]
            idx = np.concatenate(spans)
            of = np.repeat(np.arange(len(rows)), [len(s) for s in spans])
            z = np.bincount(of, vals[idx] * w[cols[idx]], minlength=len(rows))
            theta = np.concatenate(([a[0]], a[0] + np.cumsum(np.exp(a[1:]))))
            up = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -40, 40)))  # P(grade > j)
            full = np.concatenate((np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))), axis=1)
            y = grades[rows]
            i = np.arange(len(rows))
            p = np.maximum(full[i, y] - full[i, y + 1], 1e-9)
            d = full * (1 - full)  # derivative of each tail by z
            dz = (d[i, y] - d[i, y + 1]) / p
            dtheta = np.zeros((len(rows), k + 2))
            dtheta[i, y] -= d[i, y] / p
            dtheta[i, y + 1] += d[i, y + 1] / p
            dtheta = dtheta[:, 1:-1].sum(axis=0)
            da = np.concatenate(([dtheta.sum()], [dtheta[j:].sum() * np.exp(a[j]) for j in range(1, k)]))
            used, where = np.unique(cols[idx], return_inverse=True)
            grad = np.bincount(where, dz[of] * vals[idx], minlength=len(used)) - l2 * w[used] * len(rows)
            g2[used] += grad**2
            w[used] += rate * grad / np.sqrt(g2[used])
            ga += da**2
            a += rate * da / np.sqrt(ga)
    return Ordinal(w, np.concatenate(([a[0]], a[0] + np.cumsum(np.exp(a[1:])))))


def _packed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols, vals, offsets = features(b["__text"])
        rows = []
        for g, i, j in zip(b["__grade"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
            some = np.sort(np.lexsort((cols[i:j], -vals[i:j]))[:MAX_FEATURES]) + i
            rows.append((g, cols[some].astype(np.int32).tobytes(), vals[some].astype(np.float32).tobytes()))
        if rows:
            g, c, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.binary()), pa.array(v, pa.binary())], ["grade", "cols", "vals"])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """An Ordinal from labels (id, quality, toxic), training fold only (crc32 of the id as text mod 5 not 0).

    A row with quality null or id null doesn't count; toxic null counts as 0; of repeated labels the lowest grade
    counts. Without any labelled row, every document gets the same neutral score.
    """
    small_batches(docs.sparkSession)
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    fold = labels.filter(labels[id_col].isNotNull() & F.col("quality").isNotNull() & (F.crc32(labels[id_col].cast("string").cast("binary")) % 5 != 0))
    rows = fold.groupBy(labels[id_col].alias("__doc")).agg(F.min(grade).cast("int").alias("__grade"))
    sample = rows.orderBy(F.xxhash64("__doc"), "__doc").limit(MAX_ROWS)
    texts = docs.select(docs[id_col].alias("__doc"), docs[text_col].alias("__text")).join(F.broadcast(sample), "__doc")  # MAX_ROWS rows
    got = texts.select("__text", "__grade").mapInArrow(_packed_features, "grade int, cols binary, vals binary").collect()  # MAX_ROWS rows of at most 8 * MAX_FEATURES bytes
    if not got:
        return Ordinal(np.zeros(1 << BITS), np.arange(GRADES - 1, dtype=float) - 1)
    got.sort(key=lambda r: (r["grade"], bytes(r["cols"]), bytes(r["vals"])))  # the order of tasks doesn't matter
    cols = [np.frombuffer(r["cols"], np.int32) for r in got]
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in cols])))
    return fit(np.concatenate(cols), np.concatenate([np.frombuffer(r["vals"], np.float32) for r in got]), offsets, np.array([r["grade"] for r in got]))


def score(docs: DataFrame, model: Ordinal, *, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = 1, threshold: float = 0.5) -> DataFrame:
    """id_col, expected_grade, tail (P(grade >= keep_grade)), kept (tail >= threshold) per row.

    Null and empty texts have only the length's feature. Null ids and repeated rows give a row each; an empty table
    gives none; other columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                cols, vals, offsets = features(part["__text"])
                of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                tails = model.tails(np.bincount(of, vals * model.weights[cols], minlength=part.num_rows))
                tail = np.ones(part.num_rows) if keep_grade <= 0 else tails[:, keep_grade - 1]
                yield pa.RecordBatch.from_arrays([part["__id"], pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= threshold)], ["__id", "expected_grade", "tail", "kept"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scored, f"__id {kind}, expected_grade double, tail double, kept boolean").withColumnRenamed("__id", id_col)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_quality": op5_quality}
