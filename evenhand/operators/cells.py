"""The only scans of the big table that metrics need: grouped cell counts.

Partial aggregation happens before the shuffle, so a group holding a third of all rows
still arrives as a handful of partial rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import count_where


def confusion_cells(df: DataFrame, by: Sequence[str] = ("grp",), weight: str | None = None) -> DataFrame:
    """One row per ``by`` group.

    ``n, pos_n, neg_n, sel_n`` are raw row counts (support gates use rows even when the rates
    are weighted); ``tn, fp, fn, tp`` are counts, or weight sums when ``weight`` is given.
    """
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    w = F.col(weight).cast("double") if weight else F.lit(1)

    def cell(cond: Column) -> Column:
        total = F.sum(F.when(cond, w).otherwise(F.lit(0.0) if weight else F.lit(0)))
        return total if weight else total.cast("bigint")

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(y).alias("pos_n"),
        count_where(~y).alias("neg_n"),
        count_where(p).alias("sel_n"),
        cell(~y & ~p).alias("tn"),
        cell(~y & p).alias("fp"),
        cell(y & ~p).alias("fn"),
        cell(y & p).alias("tp"),
    )


def merge_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll cell rows up to coarser groups (cells are additive)."""
    names = ["n", "pos_n", "neg_n", "sel_n", "tn", "fp", "fn", "tp"]
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def ece_bin(score: str | Column, edges: Sequence[float] = tuple(V.ECE_EDGES)) -> Column:
    """0-based reliability bin: ``[low, high)``, the last one closed; NULL outside [0, 1]."""
    p = F.col(score) if isinstance(score, str) else score
    last = len(edges) - 2
    expr = F.when((p >= edges[last]) & (p <= edges[last + 1]), last)
    for i in range(last):
        expr = expr.when((p >= edges[i]) & (p < edges[i + 1]), i)
    return expr


def linear_edges(bins: int) -> list[float]:
    """Equal-width edges on [0, 1]; the stated list for ten bins, where the printed
    decimals matter."""
    if bins == 10:
        return list(V.ECE_EDGES)
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_cells(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per group and reliability bin: size, positives, score sum, squared error sum."""
    score = F.col("y_prob").cast("double")
    error = score - F.col("y_true")
    return (
        df.withColumn("bin", ece_bin(score, linear_edges(bins)))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(F.col("y_true") == 1).alias("pos_n"),
            F.sum(score).alias("score_sum"),
            F.sum(error * error).alias("sq_error"),
        )
    )


def score_cells(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positive and negative counts."""
    y = F.col("y_true") == 1
    return df.groupBy(*by, F.col("y_prob").cast("double").alias("y_prob")).agg(
        count_where(y).alias("pos"), count_where(~y).alias("neg")
    )
