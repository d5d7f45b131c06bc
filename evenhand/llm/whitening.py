"""Whitening of embeddings by shifted CholeskyQR.

The rows of the fit, centred by their exact mean, are a tall matrix X. A pass sums its Gram matrix over all tasks (one
partial sum each), takes the Cholesky factor of that plus a small shift, and replaces the rows by the solution of a
triangular system; this is repeated until the rows are orthonormal. The factors of all passes multiply to R with
X = Q R, so the singular values and right vectors of X are those of R, found on the driver from a matrix of the width
of one vector. Unlike eigenvectors of the Gram matrix itself, they do not lose half of the digits.
Rows never leave Spark; a pass reads the written fit table and moves one triangle of numbers per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch

#: Numbers of a block of rows that is worked on at a time.
CELLS = 1 << 19
PASSES = 8
#: Orthonormal enough; directions of less than this share of the largest singular value have no variance.
ENOUGH, NOTHING = 1e-9, 1e-11


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float, offset: int) -> DataFrame:
    """``id, dim, x``: floor(scale * c) + offset of every vector; null and empty vectors and those with a null or
    non-finite entry, or one beyond 64 bits, take no part. A null id stays."""
    c = F.transform(F.col(f"`{vec_col}`"), lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    fits = F.coalesce(F.forall(F.col(f"`{vec_col}`"), lambda e: F.coalesce(F.abs(e.cast("double") * F.lit(float(scale))) < 9.2e18, F.lit(False)) & ~F.isnan(e)), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.size(F.col(f"`{vec_col}`")).alias("dim"), F.when(fits, c).alias("c")).filter("c IS NOT NULL AND dim > 0")
    return rows.select("id", "dim", F.transform("c", lambda e: e + F.lit(offset)).alias("x"))


def blocks(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Rows of a list column as matrices of bounded size."""
    step = max(1, CELLS // dim)
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


@dataclass(frozen=True)
class Centre:
    """Exact centring: n x - S as whole numbers, over n only at the end."""

    n: int
    sums: tuple[int, ...]
    largest: int

    @property
    def small(self) -> bool:
        """n x - S and its square sums fit 64 bits."""
        return 4 * (self.n * self.largest) ** 2 * len(self.sums) < 1 << 62

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S; Python's whole numbers where 64 bits could overflow."""
        if self.small:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.away(x).astype(np.float64) / self.n


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangle R, column by column in blocks."""
    out, d, step = rows.copy(), len(r), 64
    for a in range(0, d, step):
        b = min(d, a + step)
        out[:, a:b] -= out[:, :a] @ r[:a, a:b]
        out[:, a:b] = np.linalg.solve(r[a:b, a:b].T, out[:, a:b].T).T
    return out


def gram_of(fit: DataFrame, dim: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of y y^T over all rows y = rows_of(x): each task sends its sum row by row, each row is summed in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for m in blocks(b.column(0), dim):
                y = rows_of(m)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(dim, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(x) for x in t["row"].to_pylist()], axis=0)
        return pa.table([t["i"].slice(0, 1), pa.array([rows.tobytes()], pa.binary())], names=["i", "row"])

    got = fit.select("x").mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    return np.stack([np.frombuffer(r["row"]) for r in sorted(got, key=lambda r: r["i"])])


def centre_of(fit: DataFrame, dim: int) -> Centre:
    """Count, exact sums and largest size of the fit's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in blocks(b.column(0), dim):
                high, low = m >> 32, m & 0xFFFFFFFF  # sums of halves cannot overflow
                cols = [pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(m))), pa.array(high.sum(0)), pa.array(low.sum(0)), pa.array(m.min(0)), pa.array(m.max(0))]
                yield pa.record_batch(cols, names=["i", "n", "high", "low", "least", "most"])

    parts = fit.select("x").mapInArrow(run, "i int, n bigint, high bigint, low bigint, least bigint, most bigint")
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    return Centre(got[0]["n"], tuple((r["high"] << 32) + r["low"] for r in got), max(max(abs(r["least"]), abs(r["most"])) for r in got))


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors as columns, by falling eigenvalue, with the exact centre they belong to."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.vectors) / np.sqrt(self.values)


def fit_whitening(fit: DataFrame, dim: int, components: int = 16) -> Whitening:
    """Components of a table of distinct vectors ``x`` of one length (written, as every pass reads it)."""
    centre = centre_of(fit, dim)
    gram = gram_of(fit, dim, centre.centred)
    trace = float(np.trace(gram)) / centre.n
    whole, factors, passes = np.eye(dim), [], 1
    unit = np.finfo(float).eps / 2
    while trace > 0:
        scale = float(np.linalg.norm(gram, 2))
        shift = 11 * (centre.n * dim + dim * (dim + 1)) * unit * scale if not factors else dim * unit * scale
        while True:
            try:
                r = np.linalg.cholesky(gram + shift * np.eye(dim)).T
                break
            except np.linalg.LinAlgError:
                shift *= 10
        factors.append(r)
        whole = r @ whole
        if passes == PASSES:
            break
        done = list(factors)

        def rows_of(x: np.ndarray) -> np.ndarray:
            y = centre.centred(x)
            for f in done:
                y = solve_rows(y, f)
            return y

        gram = gram_of(fit, dim, rows_of)
        passes += 1
        _, sizes, _ = np.linalg.svd(whole)
        rank = int((sizes > NOTHING * sizes[0]).sum())
        spectrum = np.linalg.eigvalsh(gram)[::-1][:rank]
        if np.abs(spectrum - 1).max() < ENOUGH:
            whole = np.linalg.cholesky(gram).T @ whole if rank == dim else whole
            break
    _, sizes, right = np.linalg.svd(whole)
    keep = min(components, int((sizes > NOTHING * sizes[0]).sum()) if trace > 0 else 0)
    right = right[:keep]
    sign = np.sign(right[np.arange(keep), np.abs(right).argmax(axis=1)])
    return Whitening(centre, (right * sign[:, None]).T.copy(), sizes[:keep] ** 2 / centre.n, trace, passes)


def whiten(
    df: DataFrame, components: int = 16, scale: float = 64.0, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row that takes part, and component.

    The fit holds each distinct vector once. Repeated rows are each whitened. Vectors of different lengths are fitted
    by length. A direction without variance is no component, so a single distinct vector, like an empty table, gives no
    rows. ``deviation`` is an exact whole number, DECIMAL(38,0), and an error beyond that.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = whole_vectors(df, id_col, vec_col, scale, offset)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    distinct = scratch.table(rows.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("copies")).select("dim", "x"))
    out = None
    for r in distinct.select("dim").distinct().orderBy("dim").collect():
        dim = r["dim"]
        part = _whitened(rows.filter(F.col("dim") == dim), distinct.filter(F.col("dim") == dim), dim, components, schema)
        out = part if out is None else out.unionByName(part)
    scratch.drop()
    return out if out is not None else spark.createDataFrame([], schema)


def _whitened(rows: DataFrame, fit: DataFrame, dim: int, components: int, schema: str) -> DataFrame:
    w = fit_whitening(fit, dim, components)
    keep = len(w.values)
    error = float(np.abs(gram_of(fit, dim, lambda x: np.pad(w.apply(x), ((0, 0), (0, dim - keep))))[:keep, :keep] / w.centre.n - np.eye(keep)).max()) if keep else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            at = 0
            for m in blocks(b.column(1), dim):
                k = len(m)
                ids = b.column(0).slice(at, k).take(pa.array(np.repeat(np.arange(k), keep)))
                far = w.centre.away(m)
                far = [Decimal(int(v)) for v in (far * far).sum(axis=1)]
                cols = [
                    ids, pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), k)), pa.array(np.full(k * keep, w.centre.n)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(k), keep))), pa.array(w.apply(m).ravel()),
                    pa.array(np.tile(w.values / w.trace, k)), pa.array(np.full(k * keep, error)),
                ]
                yield pa.record_batch(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += k

    return rows.select("id", "x").mapInArrow(run, schema) if keep else rows.sparkSession.createDataFrame([], schema)
