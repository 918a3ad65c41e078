"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, slices, texts
from .common import map_arrow, needed, without

FEATURES = 2048
#: Bound on the labelled rows that the model is fitted on.
MAX_TRAINING_ROWS = 6000
CUTOFF = 0.5
STEPS = 250
L2 = 1e-4
SCALE = 20.0


def hashed_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) for slices of a text column: square roots of the shares of hashed byte trigrams.

    A text under three bytes has no trigram and a zero vector.
    """
    for a, b in slices(column):
        data, offsets = texts(column.slice(a, b - a))
        wide = data.astype(np.uint64)
        with np.errstate(over="ignore"):
            codes = mix(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) if len(data) > 2 else wide[:0]
        codes = (codes & np.uint64(FEATURES - 1)).astype(np.int64)
        out = np.zeros((b - a, FEATURES), np.float32)
        for i in range(b - a):
            own = codes[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
            if len(own):
                out[i] = np.sqrt(np.bincount(own, minlength=FEATURES) / len(own))
        yield a, out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > grades[k]) = sigmoid(weights . x - thresholds[k]); thresholds ascend."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x @ self.weights * SCALE)[:, None] - self.thresholds[None, :])

    def expected(self, x: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.above(x) @ np.diff(self.grades)

    def tail(self, x: np.ndarray, grade: float) -> np.ndarray:
        """P(grade >= `grade`)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(x))
        return self.above(x)[:, k - 1] if k < len(self.grades) else np.zeros(len(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, steps: int = STEPS, l2: float = L2) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam; the thresholds are a first one and positive gaps."""
    grades, index = np.unique(y, return_inverse=True)
    cuts = len(grades) - 1
    params = np.zeros(x.shape[1] + cuts)
    share = np.cumsum(np.bincount(index, minlength=cuts + 1))[:-1] / max(1, len(y))
    start = np.log(share / (1 - share)) if cuts else np.zeros(0)
    if cuts:
        params[x.shape[1]] = start[0]
        params[x.shape[1] + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1 if cuts else 1):
        w, free = params[: x.shape[1]], params[x.shape[1] :]
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        eta = x @ w.astype(np.float32) * SCALE
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(eta - edges[index]), _sigmoid(eta - edges[index + 1])
        high, low = np.where(index == 0, 1.0, high), np.where(index == cuts, 0.0, low)
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_eta = -(d_high - d_low) / len(y)
        g_theta = np.bincount(np.maximum(index - 1, 0), d_high * (index > 0) / len(y), cuts) - np.bincount(np.minimum(index, cuts - 1), d_low * (index < cuts) / len(y), cuts)
        g_free = np.cumsum(g_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        grad = np.concatenate([x.T @ g_eta.astype(np.float32) * SCALE + l2 * w, g_free])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = params[x.shape[1] :]
    return OrdinalModel(grades.astype(float), params[: x.shape[1]].astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, x in hashed_features(batch.column("text")):
            rows = [r.tobytes() for r in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(a, len(rows)), pa.array(rows, pa.binary())], names=["grade", "x"])


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> OrdinalModel | None:
    """Fit on the labelled documents, at most about `max_rows` of them.

    Beyond the bound a hash of the doc_id decides which labelled rows are used. A document with several
    labels counts with the least; null grades and ids are left out. None without labelled documents.
    """
    rated = needed(labels, "doc_id", grade).select("doc_id", F.col(f"`{grade}`").cast("double").alias("grade")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if n > max_rows:
        part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
        rated = rated.where(part < max_rows / n)
    # At most about max_rows pairs of numbers, so the broadcast is bounded.
    sample = needed(docs, "doc_id", "text").where("text is not null").join(F.broadcast(rated), "doc_id").select("grade", "text")
    got = map_arrow(sample, _feature_rows, "grade double, x binary").toArrow()
    if not len(got):
        return None
    x, at = np.empty((len(got), FEATURES), np.float32), 0
    for chunk in got["x"].chunks:  # straight from the received buffers, without a copy of the whole
        for value in chunk:
            x[at] = np.frombuffer(value.as_buffer(), np.float16)
            at += 1
    return fit_ordinal(x, got["grade"].to_numpy())


def _scorer(model: OrdinalModel, at_least: float) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in hashed_features(batch.column("text")):
                part = batch.slice(a, len(x))
                columns = [part.column(c) for c in ("doc_id", "digest")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(model.expected(x)), pa.array(model.tail(x, at_least))],
                    names=["doc_id", "digest", "expected_grade", "tail_prob"])

    return score


def classify(docs: DataFrame, labels: DataFrame, grade: str = "quality", at_least: float | None = None,
             cutoff: float = CUTOFF, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, digest, expected_grade, tail_prob, accepted.

    The model shares one weight vector over hashed byte trigrams of the whole text between all grades and
    puts an ascending threshold between each two. tail_prob is P(grade >= at_least), with the second-lowest
    grade by default; accepted: tail_prob >= cutoff.

    Null and empty texts have a zero vector and get the thresholds' probabilities alone. Without labels,
    or with one grade only, every document is accepted with tail_prob 1 and the one grade (null without
    any). Repeated rows are scored alike. An empty table gives an empty result. Other columns are not read.
    """
    rows = needed(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    model = train(docs, labels, grade, max_rows)
    if model is None or len(model.grades) < 2:
        known = F.lit(None if model is None else float(model.grades[0])).cast("double")
        scored = rows.select("doc_id", "digest", known.alias("expected_grade"), F.lit(1.0).alias("tail_prob"))
    else:
        low = float(model.grades[1]) if at_least is None else at_least
        scored = map_arrow(rows, _scorer(model, low), "doc_id long, digest long, expected_grade double, tail_prob double")
    return scored.withColumn("accepted", F.col("tail_prob") >= cutoff)


def keep_accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier accepts."""
    return without(docs, classify(docs, labels, **options).where(~F.col("accepted")))
