"""Brier score, reliability bins, calibration error, exact ROC area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.functions.expr import ratio
from evenhand.operators.cells import linear_edges, score_cells
from evenhand.operators.order import attach, prefix_sums


def brier(cal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From calibration cells; the NULL bin (scores outside [0,1]) counts as well."""
    return cal.groupBy(*by).agg((F.sum("sq_error") / F.sum("n")).alias("brier_score"))


def reliability_bins(cal: DataFrame, bins: int = 10) -> DataFrame:
    """All bins of the whole table, empty ones with zeros."""
    edges = linear_edges(bins)
    rows = [(i, edges[i], edges[i + 1]) for i in range(bins)]
    frame = cal.sparkSession.createDataFrame(rows, "bin int, bin_low double, bin_high double")
    merged = (
        cal.filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("pos_n").alias("pos_n"), F.sum("score_sum").alias("score_sum"))
    )
    joined = frame.join(F.broadcast(merged), "bin", "left")  # at most `bins` rows
    acc, conf = ratio("pos_n", "n"), ratio("score_sum", "n")
    zero = F.lit(0.0)
    return joined.select(
        "bin",
        "bin_low",
        "bin_high",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("bin_size"),
        F.coalesce(acc, zero).alias("bin_accuracy"),
        F.coalesce(conf, zero).alias("bin_confidence"),
        F.coalesce(F.abs(acc - conf), zero).alias("bin_gap"),
    )


def calibration_error(cal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Brier and ECE per ``by`` key. Rows outside the bins stay in the denominator."""
    inside = F.when(F.col("bin").isNotNull(), F.abs(F.col("pos_n") - F.col("score_sum"))).otherwise(0.0)
    return cal.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos_n").alias("pos_n"),
        (F.sum("sq_error") / F.sum("n")).alias("brier_score"),
        (F.sum(inside) / F.sum("n")).alias("expected_calibration_error"),
    )


def group_calibration(cal: DataFrame, min_support: int = 30, group: str = "grp") -> DataFrame:
    """Per-group calibration, withheld where support is thin."""
    g = calibration_error(cal, (group,))
    neg = F.col("n") - F.col("pos_n")
    thin = (F.col("n") < min_support) | (F.col("pos_n") < 5) | (neg < 5)
    return g.select(
        group,
        F.col("n").alias("count"),
        F.col("pos_n").alias("positive_count"),
        neg.alias("negative_count"),
        F.when(thin, V.INSUFFICIENT_CALIBRATION).otherwise(V.VALID).alias("calibration_support_status"),
        F.when(~thin, F.col("brier_score")).alias("brier_score"),
        F.when(~thin, F.col("expected_calibration_error")).alias("expected_calibration_error"),
        F.when(thin, V.INSUFFICIENT_GROUP).otherwise(V.VALID).alias("status"),
    )


def roc_auc(df: DataFrame, by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows collapse to distinct scores first; running totals over the scores are taken per
    range bucket, so neither a hot score nor many scores end in one task.
    """
    scored = score_cells(df, by)
    ranked = prefix_sums(scored, "y_prob", {"neg": "neg_upto"}, by=by, buckets=buckets)
    below = F.col("neg_upto") - F.col("neg")
    twice = F.col("pos").cast("double") * (below * 2 + F.col("neg")).cast("double")
    agg = ranked.groupBy(*by).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(twice).alias("twice")
    )
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    one_class = (F.col("pos") == 0) | (F.col("neg") == 0)
    return agg.select(
        *by,
        F.try_divide(F.col("twice"), pairs * 2.0).alias("roc_auc"),
        F.when(one_class, V.DEGENERATE_TARGET).otherwise(V.VALID).alias("status"),
    )


def roc_curve(df: DataFrame, by: tuple[str, ...] = ("grp",), buckets: int | None = None) -> DataFrame:
    """TPR and FPR of ``score >= threshold`` for every distinct score of every group."""
    ranked = prefix_sums(
        score_cells(df, by), "y_prob", {"pos": "pos_upto", "neg": "neg_upto"}, by=by, buckets=buckets
    )
    totals = score_cells(df, by).groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    joined = attach(ranked, totals, list(by), "inner")
    above_pos = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    above_neg = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    return joined.select(
        *by,
        F.col("y_prob").alias("threshold"),
        above_pos.alias("tp"),
        above_neg.alias("fp"),
        "pos_all",
        "neg_all",
        ratio(above_pos, "pos_all").alias("tpr"),
        ratio(above_neg, "neg_all").alias("fpr"),
    )
