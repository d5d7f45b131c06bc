"""Boosted trees and forests on folded rows.

Trees see a number only through the bin it falls into, so rows that agree in all bins, label and weight are one cell with
a count. Spark bins and counts the rows (two scans and one aggregation); the cells number at most what the bins allow,
however many rows there are. Bagging draws how many rows of a cell a tree sees (binomial or Poisson), which has the law of
drawing row by row. Trees then grow on cells, the trees of a forest side by side in tasks. The learners are those of Spark
ML: 32 quantile bins, variance or Gini gain, log loss, means in leaves, siblings of a forest that decide alike folded.

Where rows do not fold to :data:`CELLS` cells, ``fit`` gives no model and the caller takes Spark ML's own, which moves
histograms of rows level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.session import stored

BINS = 32
#: Cells that a task may hold (about 100 bytes each).
CELLS = 2_000_000
#: A cut no bin is above.
NO_CUT = 1 << 30


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every number, ``[slots, rows]``: how many edges are below it."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]).astype(np.int32)


def slot_edges(x: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Edges per slot of the array column ``x``: between all values where there are at most ``bins``, else at quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list | None = None
        for b in batches:
            if b.num_rows:
                cols = _matrix(b.column(0)).T
                seen = [np.array([])] * len(cols) if seen is None else seen
                seen = [s if s is None else np.union1d(s, c) for s, c in zip(seen, cols)]
                seen = [None if s is None or len(s) > bins else s for s in seen]
        if seen is not None:
            values = pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))
            yield pa.record_batch([pa.array(np.arange(len(seen)), pa.int32()), values], names=["slot", "vals"])

    values: dict[int, np.ndarray | None] = {}
    for r in x.mapInArrow(few, "slot int, vals array<double>").collect():  # a row per slot and task
        old = values.get(r["slot"], np.array([]))
        both = None if old is None or r["vals"] is None else np.union1d(old, r["vals"])
        values[r["slot"]] = None if both is None or len(both) > bins else both
    probs = [i / bins for i in range(1, bins)]
    many = [i for i in sorted(values) if values[i] is None]
    at = x.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(str(i)) for i in many]).first() if many else {}
    return [np.unique(at[str(i)]) if values[i] is None else (values[i][1:] + values[i][:-1]) / 2 for i in sorted(values)]


@dataclass
class Cells:
    """Folded rows: ``code, y, w, k`` with the bins of all slots packed into ``code``."""

    edges: list[np.ndarray]
    table: DataFrame

    def __post_init__(self):
        self.sizes = [len(e) + 1 for e in self.edges]
        self.files = [re.sub(r"^file:/+", "file:///", f) for f in self.table.inputFiles()]


def fold(df: DataFrame, weight: str | None = None, limit: int = CELLS) -> Cells | None:
    """The cells of rows with ``features`` and ``y_true``, or None where they are too many for a task."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(vector_to_array("features").alias("x"), F.col("y_true").cast("int").alias("y"), w.alias("w"))
    edges = slot_edges(rows.select("x"))
    sizes = [len(e) + 1 for e in edges]
    if not edges or np.prod([float(s) for s in sizes]) > 2.0**62:
        return None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = np.zeros(b.num_rows, dtype=np.int64)
                for size, at in zip(sizes, _bins_of(_matrix(b.column(0)), edges)):
                    code = code * size + at
                yield pa.record_batch([pa.array(code), b.column(1), b.column(2)], names=["code", "y", "w"])

    counts = rows.mapInArrow(encode, "code bigint, y int, w double").groupBy("code", "y", "w").agg(F.count(F.lit(1)).alias("k"))
    table = stored(counts)
    return Cells(edges, table) if table.count() <= limit else None


class _Grown:
    """Cells in a task: bins per distinct code, ``[slots, codes]``, and place and weight of the cells of each label."""

    def __init__(self, files: list[str], sizes: list[int]):
        parts = []
        for uri in files:
            fs, at = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(at) as f:
                parts.append(pq.ParquetFile(f).read())
        t = pa.concat_tables(parts)
        # the order of the files is no matter of the result
        t = t.sort_by([("code", "ascending"), ("y", "ascending"), ("w", "ascending")])
        codes, self.place = np.unique(t["code"].to_numpy(), return_inverse=True)
        self.up, self.w, self.k = t["y"].to_numpy() == 1, t["w"].to_numpy(), t["k"].to_numpy()
        self.n, bins = len(codes), []
        for size in reversed(sizes):
            codes, at = np.divmod(codes, size)
            bins.append(at.astype(np.int32))
        self.bins, self.sizes = np.stack(bins[::-1]), sizes
        self.sides = [(self.place[y], self.w[y], np.flatnonzero(y)) for y in (self.up, ~self.up)]

    def sums(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per code: weight of label 1, weight of label 0, rows."""
        one, zero = (np.bincount(place, w * kept[at], self.n) for place, w, at in self.sides)
        return one, zero, np.bincount(self.place, kept, self.n)


def grow(cells: _Grown, a: np.ndarray, b: np.ndarray, rows: np.ndarray, depth: int, score, allowed=None) -> tuple[np.ndarray, ...]:
    """One tree, level by level: ``slot, cut`` of the inner nodes, sums of ``a`` and ``b`` of all nodes.

    ``score(a, b)`` is what a split adds up over its two sides; it must rise. ``allowed(level)`` says which slots a node
    may split by, ``[slots, nodes]``. A node that is not split hands everything to its left child.
    """
    inner = (1 << depth) - 1
    slot, cut = np.zeros(inner, dtype=np.int32), np.full(inner, NO_CUT, dtype=np.int32)
    sa, sb = np.zeros(2 * inner + 1), np.zeros(2 * inner + 1)
    sa[0], sb[0] = a.sum(), b.sum()
    live, real = np.flatnonzero(rows > 0), np.zeros(2 * inner + 1, dtype=bool)
    a, b, rows, bins, real[0] = a[live], b[live], rows[live], cells.bins[:, live], True
    at, every = np.zeros(len(live), dtype=np.int64), np.arange(len(live))
    for level in range(depth):
        first, n = (1 << level) - 1, 1 << level
        total_a, total_b = sa[first : first + n], sb[first : first + n]
        base = score(total_a, total_b)
        best, by, where = np.zeros(n), np.zeros(n, dtype=np.int32), np.full(n, NO_CUT, dtype=np.int32)
        left_a, left_b = total_a.copy(), total_b.copy()
        may = allowed(n) if allowed else None
        for s, (size, x) in enumerate(zip(cells.sizes, bins)):
            if size < 2:
                continue
            key = at * size + x
            la, lb, lr = (np.bincount(key, v, n * size).reshape(n, size).cumsum(axis=1) for v in (a, b, rows))
            ok = (lr[:, :-1] > 0) & (lr[:, :-1] < lr[:, -1:])
            la, lb = la[:, :-1], lb[:, :-1]
            gain = score(la, lb) + score(total_a[:, None] - la, total_b[:, None] - lb) - base[:, None]
            gain = np.where(ok, gain, -1.0)
            if may is not None:
                gain[~may[s]] = -1.0
            top = gain.argmax(axis=1)
            pick = np.arange(n), top
            better = gain[pick] > np.maximum(best, 1e-12 * np.abs(base))
            best[better], by[better], where[better] = gain[pick][better], s, top[better]
            left_a[better], left_b[better] = la[pick][better], lb[pick][better]
        split = real[first : first + n] & (where < NO_CUT)
        slot[first : first + n], cut[first : first + n] = np.where(split, by, 0), np.where(split, where, NO_CUT)
        child = 2 * (first + np.arange(n)) + 1
        sa[child], sb[child] = np.where(split, left_a, total_a), np.where(split, left_b, total_b)
        sa[child + 1], sb[child + 1] = total_a - sa[child], total_b - sb[child]
        real[child] = real[child + 1] = split  # what is not split stays a leaf
        at = 2 * at + (bins[slot[first + at], every] > cut[first + at])
    return slot, cut, sa, sb


def _walk(bins, slot: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaf number of every column of ``bins``, ``[slots, rows]``."""
    n = bins.shape[1]
    flat, row, at = bins.ravel(), np.arange(n), np.zeros(n, dtype=np.int64)
    for _ in range(len(slot).bit_length()):
        at = 2 * at + 1 + (flat[slot[at].astype(np.int64) * n + row] > cut[at])
    return at - len(slot)


def _boost(cells: _Grown, depth: int, rounds: int, step: float, sample: float, seed: int):
    """Trees of one boosted model: residuals of the log loss, variance gain, the first tree counts whole."""
    rng, f = np.random.default_rng(seed), np.zeros(cells.n)
    squares = lambda s, t: np.divide(s * s, t, out=np.zeros_like(s), where=t > 0)
    single = cells.k.max(initial=1) == 1
    for r in range(rounds):
        kept = cells.k if sample >= 1 else rng.random(len(cells.k)) < sample if single else rng.binomial(cells.k, sample)
        p, q, rows = cells.sums(kept)
        up, down = (1.0, -1.0) if r == 0 else (4 / (1 + np.exp(2 * f)), -4 / (1 + np.exp(-2 * f)))
        slot, cut, s, t = grow(cells, p * up + q * down, p + q, rows, depth, squares)
        leaves = slice(len(slot), None)
        value = (1.0 if r == 0 else step) * np.divide(s[leaves], t[leaves], out=np.zeros(len(slot) + 1), where=t[leaves] > 0)
        f += value[_walk(cells.bins, slot, cut)]
        yield slot, cut, value


def _tree(cells: _Grown, depth: int, bootstrap: bool, seed: int):
    """One tree of a forest: Gini gain, a random root of the slots at each node."""
    rng, slots = np.random.default_rng(seed), len(cells.sizes)
    p, q, rows = cells.sums(rng.poisson(cells.k) if bootstrap else cells.k)
    some = slots if not bootstrap else int(np.ceil(np.sqrt(slots)))  # a single tree takes all slots, as Spark ML's does
    allowed = None if some == slots else (lambda n: rng.random((slots, n)).argsort(axis=0).argsort(axis=0) < some)
    pure = lambda a, b: np.divide(a * a + b * b, a + b, out=np.zeros_like(a), where=a + b > 0)
    slot, cut, p, q = grow(cells, p, q, rows, depth, pure, allowed)
    leaf = np.append(cut == NO_CUT, np.ones(len(cut) + 1, dtype=bool))
    for i in reversed(range(len(cut))):  # siblings that decide alike are one leaf
        if leaf[2 * i + 1] and leaf[2 * i + 2] and (p[2 * i + 1] > q[2 * i + 1]) == (p[2 * i + 2] > q[2 * i + 2]):
            leaf[i] = True
    value = np.divide(p, p + q, out=np.zeros(len(p)), where=p + q > 0)
    for i in range(len(cut)):
        if leaf[i]:
            cut[i], slot[i] = NO_CUT, 0
            value[2 * i + 1] = value[2 * i + 2] = value[i]
            leaf[2 * i + 1] = leaf[2 * i + 2] = True
    return slot, cut, value[len(cut) :]


TREES = "tree int, slot array<int>, cut array<int>, value array<double>"


def _trees(cells: Cells, count: int, tasks: int, make) -> list[tuple[np.ndarray, ...]]:
    """Trees made in tasks that read the cells; ``make(grown, numbers)`` yields number and tree."""
    files, sizes = cells.files, cells.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = None
        for b in batches:
            if b.num_rows:
                grown = grown or _Grown(files, sizes)
                for i, (slot, cut, value) in make(grown, b.column(0).to_pylist()):
                    yield pa.record_batch(
                        [pa.array([i], pa.int32()), pa.array([slot.tolist()], pa.list_(pa.int32())),
                         pa.array([cut.tolist()], pa.list_(pa.int32())), pa.array([value.tolist()], pa.list_(pa.float64()))],
                        names=["tree", "slot", "cut", "value"])

    numbers = cells.table.sparkSession.range(0, count, 1, tasks)
    rows = numbers.mapInArrow(run, TREES).collect()  # the model: a few kB a tree
    return [(np.array(r["slot"], dtype=np.int32), np.array(r["cut"], dtype=np.int32), np.array(r["value"])) for r in sorted(rows)]


class TreeModel:
    """Fitted trees; ``transform`` adds ``probability`` like a model of Spark ML."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[np.ndarray, ...]], log_odds: bool):
        self.edges, self.trees, self.log_odds = edges, trees, log_odds

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, total = _bins_of(x, self.edges), np.zeros(len(x))
        for slot, cut, value in self.trees:
            total += value[_walk(bins, slot, cut)]
        return 1 / (1 + np.exp(-2 * total)) if self.log_odds else total / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        edges, trees, log_odds = self.edges, self.trees, self.log_odds
        handed = df.sparkSession.sparkContext.broadcast((edges, trees, log_odds))

        @F.pandas_udf("double")
        def upper(x: pd.Series) -> pd.Series:
            model = TreeModel(*handed.value)
            return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        out = df.withColumn("__p", upper(vector_to_array("features")))
        return out.withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p")))).drop("__p")


def fit_boosted(
    df: DataFrame, weight: str | None = None, depth: int = 4, rounds: int = 120, step: float = 0.08, sample: float = 0.85, seed: int = 42,
    limit: int = CELLS,
) -> TreeModel | None:
    """Gradient-boosted trees on ``features`` and ``y_true``; None where the rows do not fold."""
    cells = fold(df, weight, limit)
    if cells is None:
        return None
    made = lambda grown, _: enumerate(_boost(grown, depth, rounds, step, sample, seed))
    return TreeModel(cells.edges, _trees(cells, 1, 1, made), True)


def fit_forest(
    df: DataFrame, trees: int = 200, depth: int = 10, weight: str | None = None, bootstrap: bool = True, seed: int = 42, limit: int = CELLS,
) -> TreeModel | None:
    """A random forest on ``features`` and ``y_true``; None where the rows do not fold."""
    cells = fold(df, weight, limit)
    if cells is None:
        return None
    made = lambda grown, numbers: ((i, _tree(grown, depth, bootstrap, (seed, i))) for i in numbers)
    tasks = min(trees, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return TreeModel(cells.edges, _trees(cells, trees, tasks, made), False)
