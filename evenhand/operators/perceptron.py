"""A multilayer perceptron as in Spark ML (sigmoid layers, softmax, cross-entropy, L-BFGS), on blocks of rows.

Spark moves the sums: rows are written once in blocks, an evaluation is one pass over the blocks in tasks, and a row per
task with loss and slope comes back.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.session import stored

#: Rows of a block, and of a matrix product in it.
BLOCK, CHUNK = 16_384, 1024


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Weights of each layer with the bias as the last row, as views."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(weights[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def _forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Input and output of every layer; the last holds log odds of the second class against the first."""
    acts = [x]
    for k, w in enumerate(layers):
        z = acts[-1] @ w[:-1]
        z += w[-1]
        if k < len(layers) - 1:  # sigmoid in place
            np.negative(z, out=z)
            np.minimum(z, 700.0, out=z)
            np.exp(z, out=z)
            z += 1.0
            np.reciprocal(z, out=z)
        acts.append(z)
    acts[-1] = acts[-1][:, 1] - acts[-1][:, 0]
    return acts


def loss_and_slope(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the rows and its slope."""
    layers, slope, loss = _layers(weights, sizes), np.zeros_like(weights), 0.0
    slopes = _layers(slope, sizes)
    for k in range(0, len(x), CHUNK):
        acts, t = _forward(layers, x[k : k + CHUNK]), y[k : k + CHUNK]
        loss += float(np.logaddexp(0.0, np.where(t == 1, -acts[-1], acts[-1])).sum())
        off = 0.5 * (1 + np.tanh(acts[-1] / 2)) - t
        back = np.stack([-off, off], axis=1)
        for i in reversed(range(len(layers))):
            slopes[i][:-1] += acts[i].T @ back
            slopes[i][-1] += back.sum(axis=0)
            if i:
                back = back @ layers[i][:-1].T
                back *= acts[i]
                back *= 1 - acts[i]
    return loss, slope


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> np.ndarray:
    """L-BFGS: ``f`` gives value and slope. Steps meet the Wolfe conditions, found by bisection."""
    value, slope = f(w)
    pairs: deque = deque(maxlen=memory)
    for _ in range(max_iter):
        d, left = -slope, []
        for s, g, r in reversed(pairs):
            left.append(r * (s @ d))
            d = d - left[-1] * g
        if pairs:
            s, g, r = pairs[-1]
            d = d * ((s @ g) / (g @ g))
        for (s, g, r), a in zip(pairs, reversed(left)):
            d = d + (a - r * (g @ d)) * s
        down = slope @ d
        if not down < 0:
            pairs.clear()
            d, down = -slope, -(slope @ slope)
        step, low, high = (1.0 if pairs else 1.0 / max(1.0, np.sqrt(slope @ slope))), 0.0, np.inf
        for _ in range(20):
            new, after = f(w + step * d)
            if not new <= value + 1e-4 * step * down:
                high = step
            elif after @ d < 0.9 * down:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if not new < value:
            break
        s, g = step * d, after - slope
        if s @ g > 0:
            pairs.append((s, g, 1 / (s @ g)))
        w, gained = w + step * d, value - new
        value, slope = new, after
        if gained <= tol * max(abs(value), 1e-12) or np.sqrt(slope @ slope) <= tol * max(1.0, np.sqrt(w @ w)):
            break
    return w


class PerceptronModel:
    """``transform`` adds ``probability`` like a model of Spark ML."""

    def __init__(self, weights: np.ndarray, sizes: Sequence[int], loss: float):
        self.weights, self.sizes, self.loss = weights, list(sizes), loss

    def transform(self, df: DataFrame) -> DataFrame:
        weights, sizes = self.weights, self.sizes

        @F.pandas_udf("double")
        def upper(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(0.5 * (1 + np.tanh(_forward(_layers(weights, sizes), np.stack(x.to_numpy()))[-1] / 2)))

        out = df.withColumn("__p", upper(vector_to_array("features")))
        return out.withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p")))).drop("__p")


def fit_perceptron(df: DataFrame, hidden: Sequence[int] = (64, 32), max_iter: int = 100, seed: int = 42, tol: float = 1e-6) -> PerceptronModel:
    """Fitted on ``features`` and ``y_true``; takes no weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                x, y = (c.slice(k, BLOCK) for c in b.columns)
                cells = [np.asarray(x.flatten(), dtype=np.float64).tobytes(), np.asarray(y, dtype=np.float64).tobytes()]
                yield pa.record_batch([*(pa.array([c], pa.binary()) for c in cells)], names=["x", "y"])

    rows = df.select(vector_to_array("features").alias("x"), F.col("y_true").cast("double").alias("y"))
    blocks = stored(rows.mapInArrow(pack, "x binary, y binary"))
    n, width = blocks.agg(F.sum(F.length("y")) / 8, F.max(F.length("x") / F.length("y"))).first()
    sizes = [int(width or 0), *hidden, 2]

    def whole(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros_like(weights)
            for b in batches:
                for x, y in zip(b.column(0), b.column(1)):
                    y = np.frombuffer(y.as_buffer(), dtype=np.float64)
                    part = loss_and_slope(weights, sizes, np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(len(y), -1), y)
                    loss, slope = loss + part[0], slope + part[1]
            yield pa.record_batch([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

        parts = blocks.mapInArrow(run, "loss double, slope binary").collect()  # a row of sums per task
        return sum(p["loss"] for p in parts) / n, np.sum([np.frombuffer(p["slope"]) for p in parts], axis=0) / n

    rng = np.random.default_rng(seed)
    start = np.concatenate([(rng.random((a + 1) * b) * 4.8 - 2.4) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])
    weights = minimise(whole, start, max_iter, tol) if n else start
    return PerceptronModel(weights, sizes, whole(weights)[0] if n else float("nan"))
