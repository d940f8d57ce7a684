"""Quality by ordinal cumulative-link regression (operator 1).

Graded ratings 0..K-1 are modelled by one weight vector over hashed text features
and K-1 ordered thresholds: P(grade <= k) = logistic(threshold_k - w.x).  A
document's expected grade ranks it and its tail probability P(grade >= keep_from)
selects it.

Features are hashed words, hashed word shapes (letters, capitals, digits and
punctuation as classes) and the share of repeated words.  Fitting reads at most
``max_train_docs`` rated documents; every step of the quasi-Newton search sums
the gradients of all partitions in one aggregation, and the driver holds the
parameters only.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame

_SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_features(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text; an index may occur more than once, and then its values add up.

    Words: log counts of unit length.  Shapes, a word's first and last three character
    classes: shares of all words.  One feature each for the share of repeated words and
    the order of the text's length.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    counts = Counter(tokens)
    words = np.fromiter(map(zlib.crc32, [t.translate(_LOWER) for t in counts]), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= np.sqrt(value @ value) or 1.0
    shapes: Counter = Counter()
    for token, n in counts.items():
        shape = token.translate(_SHAPES)
        shapes[shape[:1] + shape[-3:]] += n
    hashed = np.fromiter(map(zlib.crc32, shapes, repeat(77)), np.int64, len(shapes))
    share = np.fromiter(shapes.values(), np.float64, len(shapes)) * (2 / max(1, len(tokens)))
    repeated = 1 - len(counts) / len(tokens) if tokens else 1.0
    whole = [zlib.crc32(f"repeats {int(repeated * 10)}".encode()), zlib.crc32(f"size {int(np.log1p(len(tokens)))}".encode())]
    return (np.concatenate((words, hashed, whole)) % dims).astype(np.int32), np.concatenate((value, share, [1.0, 1.0]))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def grade_probabilities(self, score: np.ndarray) -> np.ndarray:
        """(n, K) probabilities of the grades given w.x."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -35, 35)))
        return np.diff(np.concatenate((np.zeros((len(score), 1)), below, np.ones((len(score), 1))), axis=1), axis=1)


def unpack(params: np.ndarray, n_grades: int) -> OrdinalModel:
    """Parameters to a model: thresholds are a first value and the logs of their gaps."""
    cuts = params[: n_grades - 1]
    return OrdinalModel(params[n_grades - 1 :], np.cumsum(np.concatenate((cuts[:1], np.exp(np.clip(cuts[1:], -20, 20))))))


def loss_and_gradient(params: np.ndarray, n_grades: int, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of rated rows and its gradient by the parameters."""
    model = unpack(params, n_grades)
    grad = np.zeros_like(params)
    if not rows:
        return 0.0, grad
    sizes = np.array([len(i) for _, i, _ in rows])
    index, value = np.concatenate([i for _, i, _ in rows]), np.concatenate([v for _, _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    grade = np.array([g for g, _, _ in rows])
    score = np.bincount(row, value * model.weights[index], len(rows))
    edges = np.concatenate(([-np.inf], model.thresholds, [np.inf]))
    cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    up, low = cdf(edges[grade + 1] - score), cdf(edges[grade] - score)
    low[grade == 0], up[grade == n_grades - 1] = 0, 1
    p = np.maximum(up - low, 1e-12)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
    by_cut = np.zeros(n_grades - 1)
    np.add.at(by_cut, grade[grade < n_grades - 1], -d_up[grade < n_grades - 1])
    np.add.at(by_cut, grade[grade > 0] - 1, d_low[grade > 0])
    onward = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves all later ones
    grad[: n_grades - 1] = onward * np.concatenate(([1.0], np.exp(np.clip(params[1 : n_grades - 1], -20, 20))))
    grad[n_grades - 1 :] = np.bincount(index, value * (d_up - d_low)[row], len(model.weights))
    return float(-np.log(p).sum()), grad


def minimise(start: np.ndarray, value_of, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    x, (f, g), pairs = start, value_of(start), []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - y @ q / (s @ y))
        step, before = 1.0, f
        while step > 1e-4:
            (f2, g2), x2 = value_of(x - step * q), x - step * q
            if f2 <= f - 1e-4 * step * (g @ q):
                if (x2 - x) @ (g2 - g) > 1e-12:
                    pairs = [*pairs[-memory + 1 :], (x2 - x, g2 - g)]
                x, f, g = x2, f2, g2
                break
            step /= 2
        if before - f < 1e-4 * max(1.0, abs(f)):
            break
    return x


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, max_train_docs: int = 20_000, dims: int = 1 << 14, ridge: float = 0.05, rounds: int = 12) -> OrdinalModel:
    """Fit on the rated documents with the smallest hash of doc_id, ``max_train_docs`` at most.

    ratings: (doc_id, grade); rows without id or with a grade outside 0..n_grades-1 are
    left out, and of several grades of one document the highest counts.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    sample = rated.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(t.as_py(), dims) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))], names=["grade", "index", "value"])

    texts = doc_frame(docs).join(F.broadcast(sample), "doc_id").select("grade", "text")
    rows = cut_lineage(texts.mapInArrow(featurise, "grade int, index array<int>, value array<double>"))
    counts = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return unpack(np.zeros(n_grades - 1 + dims), n_grades)
    sc = rows.sparkSession.sparkContext

    def value_of(params: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(params)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = 0.0, np.zeros(len(shared.value))
            for batch in batches:
                part = [(g.as_py(), np.asarray(i.values), np.asarray(v.values)) for g, i, v in zip(*batch.columns, strict=True)]
                one, by = loss_and_gradient(shared.value, n_grades, part)
                loss, grad = loss + one, grad + by
            own = np.flatnonzero(grad)
            yield pa.record_batch([pa.array(np.concatenate(([-1], own)), pa.int64()), pa.array(np.concatenate(([loss], grad[own])))], names=["j", "g"])

        summed = rows.mapInArrow(partial, "j long, g double").groupBy("j").agg(F.sum("g").alias("g")).toArrow()
        shared.unpersist()
        j, g = summed.column("j").to_numpy(), summed.column("g").to_numpy()
        grad = np.zeros(len(params))
        grad[j[j >= 0]] = g[j >= 0]
        w = params.copy()
        w[: n_grades - 1] = 0
        return float(g[j < 0].sum()) + ridge * float(w @ w), grad + 2 * ridge * w

    upto = np.clip(np.cumsum([counts.get(k, 0) for k in range(n_grades - 1)]) / total, 0.01, 0.99)
    cuts = np.log(upto / (1 - upto))
    start = np.concatenate((cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1)), np.zeros(dims)))
    return unpack(minimise(start, value_of, rounds), n_grades)


def quality(docs: DataFrame, model: OrdinalModel, keep_from: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every document.

    tail_probability is P(grade >= keep_from) and keep says that it reaches the
    threshold.  Null and empty texts score on an empty feature set; repeated rows are
    returned as often as they occur.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dims = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = np.array([m.weights[i] @ v for i, v in (text_features(t.as_py(), dims) for t in batch.column(1))], float)
            p = m.grade_probabilities(score)
            tail = p[:, keep_from:].sum(axis=1)
            yield pa.record_batch([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= threshold)], names=["doc_id", "expected_grade", "tail_probability", "keep"])

    return doc_frame(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")
