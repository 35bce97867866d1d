"""A quality classifier learnt from trusted positives and unlabelled text.

Non-negative unbiased risk: with class prior ``pi``, the risk of the positives as positives counts ``pi`` times, and the
risk of the unlabelled rows as negatives has ``pi`` times that of the positives as negatives taken off, never below zero.
Negative labels are not used. The prior is estimated too: a classifier of positives against unlabelled rows is fitted on
one half of both, and on the other half the least ratio of the two shares above any of its scores bounds the part
of the unlabelled rows that looks like positives.

The model is linear over features of the whole text: how long, how repetitive and how marked up it is, and hashed
frequencies of byte pairs and triples. Losses are logistic and steps take all rows, so a step needs of the unlabelled rows
only a sum of losses and a gradient.

Every document that is not held out is an unlabelled row: its features are written once to the shared folder, and means,
scales, prior, losses, gradients and curvatures are sums over that table, one pass a step. Only the positives are a sample, of
at most ``SAMPLE`` labelled rows, those least in a hash of their id; it reaches the driver as features. Every document is scored.

Null texts count as empty; null ids are held out of training; with fewer than two positives or unlabelled rows every score
is the prior given for that case. Rows that repeat count each time. Very long texts are read a piece at a time. Extra
columns are ignored, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.llm.arrow_runs import small
from citeframe.sources.scratch import new_path

#: Most positives that the fit sees. Unlabelled rows have no limit.
SAMPLE = 8000
N_HASHED = 128
#: Steps of the fit, each one pass over the unlabelled rows, and the length of the first.
STEPS = 100
RATE = 0.2
THRESHOLD = 0.3
FOLDS = 5
#: Added to a text's length before its frequencies are taken, so that a few words do not weigh like a whole text.
SMOOTHING = 150
#: Bytes that are turned into features at a time.
PIECE = 1 << 20
#: Rows of features that a task holds as numbers at a time.
ROWS = 1000

# Features

_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _KIND[_b] = 1
    elif _c.islower():
        _KIND[_b] = 2
    elif _c.isupper():
        _KIND[_b] = 3
    elif _c.isdigit():
        _KIND[_b] = 4
    elif _c in " \t":
        _KIND[_b] = 5
    elif _c in "\n\r\v\f":
        _KIND[_b] = 6
    elif _c in ".,;:'?-()\"":
        _KIND[_b] = 7
    elif _c == "!":
        _KIND[_b] = 8
    else:
        _KIND[_b] = 9
N_SHAPE = 10 + 8
N_FEATURES = N_SHAPE + N_HASHED


def features(text: str | None) -> np.ndarray:
    """Features of one text; all of it counts, a piece at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds, hashed = np.zeros(10), np.zeros(N_HASHED)
    for start in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[start : start + PIECE + 2], np.uint8)
        here = min(PIECE, len(raw) - start)
        kinds += np.bincount(_KIND[b[:here]], minlength=10)
        pair = b[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + b[1:].astype(np.uint32) * np.uint32(0x85EBCA77)
        triple = pair[:-1] + b[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
        half = N_HASHED // 2
        hashed[:half] += np.bincount((pair[:here] * np.uint32(2654435761) >> np.uint32(16)) % half, minlength=half)
        hashed[half:] += np.bincount((triple[:here] * np.uint32(2654435761) >> np.uint32(16)) % half, minlength=half)
    words = raw.split()
    lines = raw.split(b"\n")
    n, m = len(words), max(1, len(words))
    distinct = len(set(words))
    repeated = sum(map(bytes.__eq__, words[1:], words[:-1]))
    shape = [
        np.log1p(len(raw)) / 10, distinct / m, np.log1p(n) - np.log1p(distinct), min(1.0, 4 * repeated / (m + 5)), min(4.0, np.log1p(repeated)),
        min(20.0, len(raw) / m) / 10, np.log(len(lines) / len(set(lines))), float(n == 0),
    ]
    total = len(raw) + SMOOTHING
    return np.concatenate([shape, np.sqrt(kinds / total), np.sqrt(hashed / total)])


def _matrix(column: pa.Array) -> np.ndarray:
    texts = column.to_pylist()
    known: dict[str | None, np.ndarray] = {}
    for t in texts:
        if t not in known:
            known[t] = features(t)
    return np.array([known[t] for t in texts]).reshape(len(texts), N_FEATURES)


# Sums over rows


#: Takes a block of features, gives sums over its rows.
Measure = Callable[[np.ndarray], np.ndarray]


class _Block:
    """Rows held here."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def halves(self) -> tuple[_Block, _Block]:
        return _Block(self.x[::2]), _Block(self.x[1::2])

    def total(self, measure: Measure) -> np.ndarray:
        return measure(self.x)


class _Table:
    """Rows of a stored table ``(half boolean, x binary)``; a pass sums in the tasks, then by place."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def halves(self) -> tuple[_Table, _Table]:
        return _Table(self.rows.filter("half")), _Table(self.rows.filter("not half"))

    def total(self, measure: Measure) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = measure(np.zeros((0, N_FEATURES)))
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    raw = b"".join(batch.column("x").slice(start, ROWS).to_pylist())
                    total = total + measure(np.frombuffer(raw, np.float32).reshape(-1, N_FEATURES).astype(np.float64))
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total[place])], ["place", "total"])

        sums = measure(np.zeros((0, N_FEATURES)))
        found = self.rows.select("x").mapInArrow(run, "place int, total double")
        found = found.groupBy("place").agg(F.sum("total").alias("total")).toArrow()
        sums[found["place"].to_numpy()] = found["total"].to_numpy()
        return sums


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


@dataclass(frozen=True)
class _Standard:
    """Standardises features and puts a constant first."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], axis=1)


@dataclass(frozen=True)
class _Curve:
    """Means over rows at a point: softplus(z), its gradient, the row itself, and where asked for its second derivatives."""

    loss: float
    gradient: np.ndarray
    centre: np.ndarray
    curvature: np.ndarray | None


def _curve(rows: _Block | _Table, ready: _Standard, w: np.ndarray, second: bool = False) -> _Curve:
    def measure(x: np.ndarray) -> np.ndarray:
        x = ready(x)
        z = x @ w
        s = _logistic(z)
        bends = ((x.T * (s * (1 - s))) @ x).ravel() if second else []
        return np.concatenate([[len(x), np.logaddexp(0, z).sum()], x.T @ s, x.sum(axis=0), bends])

    total, k = rows.total(measure), len(w)
    mean = total[1:] / max(total[0], 1.0)
    return _Curve(mean[0], mean[1 : k + 1], mean[k + 1 : 2 * k + 1], mean[2 * k + 1 :].reshape(k, k) if second else None)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Fit


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return _logistic(z)


def _newton(at: Callable, w: np.ndarray, tol: float = 1e-7, steps: int = 50) -> np.ndarray:
    """Minimum of a smooth, strictly convex function from ``at(w) = value, gradient, curvature``."""
    value, gradient, curvature = at(w)
    for _ in range(steps):
        way, length = np.linalg.solve(curvature, gradient), 1.0
        gain = gradient @ way
        if gain <= tol:
            break
        tried = at(w - way)
        while tried[0] > value - 1e-4 * length * gain and length > 1e-6:
            length /= 2
            tried = at(w - length * way)
        w, (value, gradient, curvature) = w - length * way, tried
    return w


def _adam(gradient: Callable, n: int) -> np.ndarray:
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positives: np.ndarray, unlabelled: _Block | _Table, ready: _Standard, l2: float = 1e-3) -> float:
    """Share of positives among the unlabelled rows."""
    (fit_p, p), (fit_u, u) = _Block(positives).halves(), unlabelled.halves()
    eye = np.eye(N_FEATURES + 1)

    def at(w):
        a, b = _curve(fit_p, ready, w, True), _curve(fit_u, ready, w, True)
        value = a.loss - a.centre @ w + b.loss + l2 / 2 * w @ w
        return value, a.gradient - a.centre + b.gradient + l2 * w, a.curvature + b.curvature + l2 * eye

    w = _newton(at, np.zeros(N_FEATURES + 1))
    cuts = np.quantile(ready(p.x) @ w, np.linspace(0, 0.98, 99))

    def above(x: np.ndarray) -> np.ndarray:
        z = np.sort(ready(x) @ w)
        return np.concatenate([[len(z)], len(z) - np.searchsorted(z, cuts, "left")]).astype(np.float64)

    in_p, in_u = p.total(above), u.total(above)
    n_u = max(in_u[0], 1.0)
    above_p, above_u = in_p[1:] / in_p[0], in_u[1:] / n_u
    slack = np.sqrt(np.log(100) / 2) * (1 / np.sqrt(in_p[0]) + 1 / np.sqrt(n_u))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray | _Table, no_data_prior: float = 0.5, l2: float = 2e-3) -> Model:
    """Minimises the non-negative risk by full-batch steps; where the negative part falls below zero, a step raises it."""
    n = N_FEATURES
    rows = unlabelled if isinstance(unlabelled, _Table) else _Block(unlabelled)
    moments = rows.total(_moments)
    if len(positives) < 2 or moments[0] < 2:
        return Model(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(no_data_prior / (1 - no_data_prior))), no_data_prior)
    mean = moments[1 : n + 1] / moments[0]
    ready = _Standard(mean, np.sqrt(np.maximum(moments[n + 1 :] / moments[0] - mean * mean, 0)) + 1e-3)
    prior = estimate_prior(positives, rows, ready)
    penalty = np.full(n + 1, l2)
    penalty[0] = 0
    trusted = _Block(positives)

    def gradient(w):
        p, u = _curve(trusted, ready, w), _curve(rows, ready, w)
        g_negative = u.gradient - prior * p.gradient
        below = u.loss - prior * p.loss < 0
        return (-g_negative if below else prior * (p.gradient - p.centre) + g_negative) + penalty * w

    w = _adam(gradient, n + 1)
    return Model(ready.mean, ready.scale, w[1:], float(w[0]), prior)


# Spark


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True for one row in ``folds``, by the checksum of the id; true without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _packed(column: pa.Array) -> pa.Array:
    return pa.array([r.tobytes() for r in _matrix(column).astype(np.float32)], pa.binary())


def _sample(ids: DataFrame, docs: DataFrame, limit: int) -> np.ndarray:
    """Features of the documents with the ``limit`` ids least in a hash."""
    picked = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([batch.column("h"), _packed(batch.column("text"))], ["h", "x"])

    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    # An id that repeats cannot bring in more than the limit.
    rows = rows.dropDuplicates(["h"]).orderBy("h").limit(limit)
    found = rows.mapInArrow(extract, "h bigint, x binary").toArrow().sort_by("h")
    return np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _unlabelled(docs: DataFrame) -> _Table:
    """Features of all documents that are not held out, written once; copies of an id share a half."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", PIECE):
            yield pa.RecordBatch.from_arrays([batch.column("half"), _packed(batch.column("text"))], ["half", "x"])

    half = (F.xxhash64(F.col("doc_id").cast("string")) % 2 == 0).alias("half")
    path = new_path(docs.sparkSession, "quality-features")
    rows = docs.filter(~held_out(F.col("doc_id"))).select(half, "text")
    rows.mapInArrow(extract, "half boolean, x binary").write.parquet(path)
    return _Table(docs.sparkSession.read.schema("half boolean, x binary").parquet(path))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on rows that are not held out: ids labelled 1 are positives, all documents are unlabelled."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    positive_ids = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
    return fit(_sample(positive_ids, docs, sample), _unlabelled(docs))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a whole text."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        parts = small([pa.RecordBatch.from_arrays([texts], ["text"])], "text", PIECE)
        found = [model.scores(_matrix(part.column("text"))) for part in parts]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    return scores(text)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose ``text`` scores ``threshold`` or more. Rows pass through tasks about ``PIECE`` bytes of
    text at a time: a filter by ``score`` would hold a batch of whole rows beside the texts that are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", PIECE):
            yield batch.filter(pa.array(model.scores(_matrix(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
