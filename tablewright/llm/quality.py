"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their class counts, and a linear hinge-loss model is fitted to them by
dual coordinate descent. Platt scaling on rows the model has not seen turns margins into scores.

Defined results: null and empty texts have no n-gram and get the score of the bias; labels of unknown documents, null labels
and labels outside {0, 1} are left out; of several labels of one document the smallest counts; repeated documents are scored
each; without labels of both classes every score is the share of label 1 (0.5 without any). An empty table gives no rows. Extra
columns pass through ``score_quality`` untouched unless they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BLOCK_BYTES, extended, forget, held_out, map_batches, platt, sigmoid, text_bytes, within_bytes, written

#: The model is fitted on at most this many labelled rows, chosen by a hash of the id.
FIT_ROWS = 6000
#: Bytes of features of these rows, beyond which no further row is taken; a row has 4 bytes for each n-gram it holds.
FIT_BYTES = 128_000_000
#: Every third of them is kept out of the fit and calibrates the score.
CALIBRATE_EVERY = 3
THRESHOLD = 0.7

_BITS = 16
#: (letters kept or mapped to their shape, length) of the n-grams of bytes.
_GRAMS = (("shape", 2), ("shape", 4), ("shape", 6), ("raw", 3))
_REPEATS = 8
FEATURES = (len(_GRAMS) << _BITS) + _REPEATS


def _shapes() -> np.ndarray:
    """Byte to shape: letters by case, digits and bytes beyond ASCII as one class each, all others themselves."""
    shape = np.arange(256, dtype=np.uint32)
    shape[ord("a") : ord("z") + 1] = ord("a")
    shape[128:] = ord("a")
    shape[ord("A") : ord("Z") + 1] = ord("A")
    shape[ord("0") : ord("9") + 1] = ord("0")
    return shape


_SHAPE = _shapes()


def text_features(text: bytes) -> np.ndarray:
    """Sorted ids of the n-grams that the whole text holds.

    N-grams of bytes and of byte shapes, and the n-gram "a word twice in a row" by the share of words it takes.
    """
    seen = np.zeros(FEATURES, dtype=bool)
    for start in range(0, len(text), BLOCK_BYTES):
        raw = np.frombuffer(text, np.uint8, min(BLOCK_BYTES + 5, len(text) - start), start)
        views = {"raw": raw.astype(np.uint32), "shape": _SHAPE[raw]}
        for k, (kind, n) in enumerate(_GRAMS):
            a = views[kind]
            if len(a) < n:
                continue
            size = len(a) - n + 1
            h = a[:size].copy()
            for i in range(1, n):
                h *= np.uint32(0x01000193)
                h += a[i : i + size]
            h *= np.uint32(0x9E3779B1)
            seen[(h >> np.uint32(32 - _BITS)) + np.uint32(k << _BITS)] = True
    words = text.split()
    if len(words) > 1:
        share = sum(map(eq, words, words[1:])) / (len(words) - 1)
        for i, least in enumerate((0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)):
            seen[(len(_GRAMS) << _BITS) + i] = share >= least
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class QualityModel:
    """Weights in the scaled space times the scale, squares of the scale, and what maps margins to scores."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        norm = float(self.square[features].sum()) ** 0.5
        return (float(self.weight[features].sum()) / norm if norm else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        return float(sigmoid(self.slope * self.margin(text_features(text)) + self.offset))


def _log_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(FEATURES, smooth), np.full(FEATURES, smooth)
    for ids, label in zip(rows, y, strict=True):
        (p if label else q)[ids] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty: one dual variable after the other, in an order shuffled by a fixed seed."""
    sign = np.where(y == 1, 1.0, -1.0)
    # Both classes weigh the same in total.
    upper = np.where(y == 1, cost * len(y) / (2 * (y == 1).sum()), cost * len(y) / (2 * (y == 0).sum()))
    values = []
    for ids in rows:
        v = scale[ids]
        norm = np.linalg.norm(v)
        values.append(v / norm if norm else v)
    diagonal = np.array([v @ v + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, v = rows[i], values[i]
            gradient = sign[i] * (w[ids] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[ids] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]) / upper[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> QualityModel:
    """Fit on feature rows with labels 0 and 1 (at least one of each in the part that is fitted)."""
    y = np.asarray(y)
    calibrates = np.arange(len(y)) % CALIBRATE_EVERY == CALIBRATE_EVERY - 1
    if min((y[~calibrates] == k).sum() for k in (0, 1)) == 0 or min((y[calibrates] == k).sum() for k in (0, 1)) == 0:
        calibrates[:] = False
    if min((y == k).sum() for k in (0, 1)) == 0:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        zero = np.zeros(FEATURES)
        return QualityModel(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    fitted = np.flatnonzero(~calibrates)
    part = [rows[i] for i in fitted]
    scale = _log_ratio(part, y[fitted])
    w, bias = _dual_descent(part, y[fitted], scale, cost, rounds)
    plain = QualityModel(w * scale, scale**2, bias, 1.0, 0.0)
    judged = np.flatnonzero(calibrates) if calibrates.any() else fitted
    slope, offset = platt(np.array([plain.margin(rows[i]) for i in judged]), y[judged])
    return QualityModel(plain.weight, plain.square, bias, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> QualityModel:
    """Fit on a sample, bounded in rows and in bytes, of the labelled rows that are not held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("__y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [text_features(t).tobytes() for t in text_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__y"), pa.array(ids, pa.binary())], ["doc_id", "y", "ids"])

    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # A repeated id has one vote, that of its smallest features.
    held = map_batches(sample, features, "doc_id long, y int, ids binary")
    held = written(held.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("ids").alias("ids")), "labelled")
    got = sorted(within_bytes(held, F.octet_length("ids"), most_bytes), key=lambda r: r["doc_id"])
    forget(held)
    return fit_rows([np.frombuffer(bytes(r["ids"]), np.int32) for r in got], np.array([r["y"] for r in got], dtype=np.int64))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the threshold)."""
    docs = docs.drop("score", "predicted")
    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t) for t in text_bytes(batch.column("text"))]
        columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(lambda batches: (score(b) for b in batches), extended(docs, "score double, predicted int"))
