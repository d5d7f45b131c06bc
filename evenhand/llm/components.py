"""Connected components of an edge table by random contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.scratch import Scratch

#: Rows of an edge table that one task solves (16 bytes each); larger ones are contracted first.
ONE_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in ``edges(a, b)``; self-loops name lone ids.

    A table of up to ``ONE_TASK`` edges is solved in one task. A larger one is contracted: every vertex takes the name
    of the vertex with the smallest keyed hash among itself and its neighbours, and edges between names go on. A random
    order shrinks paths and stars alike, so rounds grow with the logarithm of the edges. Names fold map-side; joins
    meet written tables only, so that AQE can split a hub's rows. Nothing is collected.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a IS NOT NULL AND b IS NOT NULL")
    todo = scratch.table(ends.distinct())
    size = todo.count()
    if size <= ONE_TASK:
        out = scratch.table(_solve(todo))
        scratch.drop([out])
        return out
    ids = scratch.table(todo.select(F.col("a").alias("id")).union(todo.select(F.col("b").alias("id"))).distinct())
    todo, maps = scratch.table(todo.filter("a <> b")), []
    while size > ONE_TASK:
        name, todo = _contract(todo, len(maps), scratch)
        maps.append(name)
        size = todo.count()
    whole = scratch.table(_solve(todo).withColumnRenamed("component", "name"))
    for m in reversed(maps):
        after = whole.select(F.col("id").alias("name"), F.col("name").alias("last"))
        whole = scratch.table(m.join(after, "name", "left").select("id", F.coalesce("last", "name").alias("name")))
    least = scratch.table(whole.groupBy("name").agg(F.min(F.least("id", "name")).alias("component")))
    found = whole.join(least, "name").select("id", "component")
    out = scratch.table(ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    scratch.drop([out])
    return out


def _contract(todo: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Names ``id, name`` of this round's vertices, and the edges between different names."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
    both = todo.select("a", "b").union(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(order("b")).alias("n"))
    name = scratch.table(best.select(F.col("a").alias("id"), F.least("n", order("a"))["v"].alias("name")))
    half = todo.join(name.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").select("x", "b")
    full = half.join(name.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    pair = full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b")
    return name, scratch.table(pair.distinct())


def _solve(edges: DataFrame) -> DataFrame:
    """Components of a table that is known to fit one task: every label falls to the smallest of its neighbours'."""

    def solve(t: pa.Table) -> pa.Table:
        ids, ends = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
        a, b = ends[: t.num_rows], ends[t.num_rows :]
        label = np.arange(len(ids))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            np.minimum.at(low, label[a], label[b])  # whole classes move, not single vertices
            np.minimum.at(low, label[b], label[a])
            low = low[low]
            if (low == label).all():
                return pa.table([pa.array(ids), pa.array(ids[label])], names=["id", "component"])
            label = low

    one = edges.select("a", "b", F.lit(0).alias("part"))
    return one.groupBy("part").applyInArrow(solve, "id bigint, component bigint").coalesce(1)
