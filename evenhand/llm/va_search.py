"""Exact top-k by inner product over vector-approximation files.

Vectors are whole numbers, floor(scale * x). A vector-approximation file holds one byte per component: the cell of the
number among marks that split each dimension evenly. From a cell follow the least and the largest value of a
component, and so bounds of the score with a query, two matrix products for a block of cells.

Pass 1 scans cells only. Each task keeps what can still be among its k best: candidates whose upper bound reaches its
kth best lower bound. The best of these limits over the tasks holds for all. Pass 2 reads exact vectors in the order of
the bounds: first the k best-bounded of each query, then only candidates whose bound reaches the kth score so found.
What is left out is certain to be worse; ties are read, as they go by the smaller id.
Queries go in chunks of bounded size, the only data that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch

BITS = 8
#: Vectors that place the marks (the outer cells reach to the extremes of all vectors), queries of a pass, block rows,
#: and rows of a block that are held against all queries at a time.
SAMPLE = 10_000
QUERIES = 4096
BLOCK = 4096
TILE = 512
#: Scores beyond 64 bits are held here; one of them among the results is an error.
MOST = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id, dim, v``: floor(scale * x) of every vector that takes part.

    Null vectors, vectors with null or non-finite components, and those whose whole numbers do not fit 64 bits
    take no part.
    """
    x = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double") * F.lit(float(scale)))
    good = F.coalesce(F.forall(x, lambda e: F.coalesce(F.abs(e) < 9.2e18, F.lit(False)) & ~F.isnan(e)), F.lit(False))
    kept = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.alias("x"), good.alias("good")).filter("good")
    return kept.select("id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e)).alias("v"))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, no further from 0 than ``MOST``."""
    out = np.einsum("ij,ij->i", a, b) if a.shape[1] else np.zeros(len(a), np.int64)
    size = lambda m: np.abs(m.astype(float)).max(axis=1, initial=0)
    for i in np.flatnonzero(size(a) * size(b) * max(1, a.shape[1]) >= 2.0**62).tolist():
        whole = sum(int(x) * int(y) for x, y in zip(a[i], b[i]))
        out[i] = max(-MOST, min(MOST, whole))
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def marks_of(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each cell, ``[dim, cells]``; the outermost are the extremes of all vectors."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0), dim)
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = vectors.select("v").mapInArrow(extremes, "d int, low bigint, high bigint")
    ends = {r["d"]: (r["low"], r["high"]) for r in ends.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    some = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = np.sort(matrix(some, dim), axis=0)
    cells = 1 << BITS
    least, most = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
    for d in range(dim):
        starts = np.unique(sample[np.arange(1, cells) * len(sample) // cells, d])
        starts = starts[(starts > ends[d][0]) & (starts <= ends[d][1])]
        begin = np.concatenate([[ends[d][0]], starts])
        stop = np.concatenate([starts - 1, [ends[d][1]]])
        least[d], most[d] = np.pad(begin, (0, cells - len(begin)), mode="edge"), np.pad(stop, (0, cells - len(stop)), mode="edge")
    return least, most


def approximate(vectors: DataFrame, least: np.ndarray) -> DataFrame:
    """The vector-approximation file: blocks of up to ``BLOCK`` ids, row numbers and cells."""
    dim = len(least)
    starts = [np.unique(row) for row in least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                m = matrix(part.column(1), dim)
                cells = np.empty(m.shape, dtype=np.uint8)
                for d in range(dim):
                    cells[:, d] = np.searchsorted(starts[d], m[:, d], side="right") - 1
                ids, rows = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (ids, rows, cells)], names=["ids", "rows", "cells"])

    return vectors.select("id", "v", "row").mapInArrow(run, "ids binary, rows binary, cells binary")


class Kept:
    """The k best lower bounds so far of every query, and the candidates that may still count."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, most: np.ndarray, k: int):
        self.up, self.down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
        self.query_ids, self.least, self.most, self.k = query_ids, least.astype(float), most.astype(float), k
        self.best = np.full((len(queries), k), -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
        for a in range(0, len(ids), TILE):
            self._add(ids[a : a + TILE], rows[a : a + TILE], cells[a : a + TILE])

    def _add(self, ids: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> None:
        d = np.arange(cells.shape[1])
        low, high = self.least[d, cells], self.most[d, cells]
        upper = self.up @ high.T + self.down @ low.T
        lower = self.up @ low.T + self.down @ high.T
        largest = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * np.abs(self.up - self.down).max(initial=0) * max(1, len(d))
        if largest >= 2.0**53:  # a double rounds; the margin covers every order of adding
            slack = 1e-12 * (np.abs(self.up - self.down) @ np.maximum(np.abs(low), np.abs(high)).T)
            upper, lower = upper + slack, lower - slack
        own = self.query_ids[:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        self.best = -np.partition(-np.concatenate([self.best, lower], axis=1), self.k - 1, axis=1)[:, : self.k]
        q, j = np.nonzero((upper >= self.limit[:, None]) & (upper > -np.inf))
        self.rows.append((q, rows[j], upper[q, j]))

    @property
    def limit(self) -> np.ndarray:
        return self.best.min(axis=1)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, rows, upper = (np.concatenate(x) for x in zip(*self.rows))
        ok = upper >= self.limit[q]
        return q[ok], rows[ok], upper[ok]


def _pass(vectors: DataFrame, file: DataFrame, some: pa.Table, dim: int, marks: tuple[np.ndarray, np.ndarray], k: int, scratch: Scratch) -> DataFrame:
    """Top k of one chunk of queries."""
    durable = scratch.table
    query_ids = some["id"].to_numpy()
    queries = matrix(some["v"].combine_chunks(), dim)
    least, most = marks

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(queries.astype(float), query_ids, least, most, k)
        for b in batches:
            for ids, rows, cells in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(ids, dtype=np.int64)
                kept.add(ids, np.frombuffer(rows, dtype=np.int64), np.frombuffer(cells, dtype=np.uint8).reshape(len(ids), dim))
        q, rows, upper = kept.result()
        known = np.flatnonzero(kept.limit > -np.inf)  # a row without number carries the limit
        yield pa.record_batch(
            [pa.array(np.concatenate([q, known]).astype(np.int32)), pa.array(np.concatenate([rows, known]), mask=np.arange(len(q) + len(known)) >= len(q)), pa.array(np.concatenate([upper, kept.limit[known]]))],
            names=["q", "row", "bound"],
        )

    found = durable(file.mapInArrow(scan, "q int, row bigint, bound double"))
    limit = F.coalesce("limit", F.lit(float("-inf")))
    limits = found.filter("row IS NULL").groupBy("q").agg(F.max("bound").alias("limit"))
    open_ = found.filter("row IS NOT NULL").join(limits, "q", "left").filter(F.col("bound") >= limit).select("q", "row", "bound")
    order = W.partitionBy("q").orderBy(F.desc("bound"), "row")
    open_ = durable(open_.withColumn("at", F.row_number().over(order)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(0).to_numpy(zero_copy_only=False)
            s = inner_products(queries[q], matrix(b.column(2), dim))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s)], names=["q", "id", "score"])

    def read(candidates: DataFrame) -> DataFrame:
        return candidates.select("q", "row").join(vectors.select("row", "id", "v"), "row").select("q", "id", "v").mapInArrow(score, "q int, id bigint, score bigint")

    first = durable(read(open_.filter(F.col("at") <= k)))
    certain = first.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    second = open_.filter(F.col("at") > k).join(certain, "q", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    every = first.unionByName(read(second))
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(query_ids[b.column(0).to_numpy(zero_copy_only=False)]), *b.columns[1:]], names=["query_id", "rank", "vec_id", "score"])

    score_ = F.when(F.abs("score") < MOST, F.col("score")).otherwise(F.raise_error(F.lit("a score among the results does not fit 64 bits")).cast("bigint"))
    return ranked.select("q", "rank", "id", score_.alias("score")).mapInArrow(name, "query_id bigint, rank int, vec_id bigint, score bigint")


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for every query row, exactly.

    ``is_query`` is a condition on ``id``. Candidates of a query are all rows with another id and as many components.
    Equal scores go by the smaller id. Equal query rows are one query; repeated candidate rows each count once. Rows
    without an id take no part. With fewer than ``k`` candidates all are given; an empty table gives no rows. Scores are
    exact however large the components are; one that does not fit 64 bits and belongs to the results is an error.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    numbered = whole_vectors(df, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id())
    vectors = scratch.table(numbered)  # numbers hold once they are written
    asked = scratch.table(vectors.filter(is_query).select("id", "dim", "v").distinct())
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for r in sorted(asked.groupBy("dim").count().collect()):
        dim, n = r["dim"], r["count"]
        same = vectors.filter(F.col("dim") == dim)
        marks = marks_of(same, dim)
        file = scratch.table(approximate(same, marks[0]))
        chunks = -(-n // QUERIES)
        for c in range(chunks):
            chunk = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(chunks)) == c))
            some = chunk.select("id", "v").orderBy("id").toArrow()
            if some.num_rows:
                out = out.union(scratch.table(_pass(same, file, some, dim, marks, k, scratch)))
    found = scratch.table(out)
    scratch.drop([found])
    return found
