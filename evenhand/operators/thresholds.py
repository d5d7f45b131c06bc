"""Per-group decision thresholds from ROC tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.expr import draw32
from evenhand.operators.calibration import roc_curve
from evenhand.operators.order import attach
from evenhand.operators.splits import require_no_holdout
from evenhand.session import stored

RULE = (
    "grp string, p_ignore double, prediction_constant double, p0 double, threshold0 double, p1 double, threshold1 double"
)


def balanced_thresholds(roc: DataFrame) -> DataFrame:
    """Threshold with the best balanced accuracy per group (the smallest on a tie)."""
    balanced = (F.col("tpr") + 1.0 - F.col("fpr")) / 2.0
    best = F.max_by(F.struct("threshold", "tpr", "fpr", balanced.alias("bal")), F.struct(balanced, -F.col("threshold")))
    return roc.filter("pos_all > 0 AND neg_all > 0").groupBy("grp").agg(best.alias("b")).select(
        "grp", F.col("b.threshold").alias("threshold"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"),
        F.col("b.bal").alias("balanced_accuracy"),
    )


def apply_thresholds(df: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """``score >= threshold of the group``; groups without one use the default."""
    joined = attach(df, thresholds.select("grp", F.col("threshold").alias("__t")), ["grp"])
    cut = F.coalesce("__t", F.lit(default))
    return joined.withColumn("y_pred", (F.col("y_prob") >= cut).cast("int")).drop("__t")


# --- equalized odds with randomised mixing -------------------------------------------------------

def _hull(points: np.ndarray) -> np.ndarray:
    """Upper hull of (fpr, tpr, threshold) rows sorted by fpr then tpr."""
    kept: list[np.ndarray] = []
    for p in points:
        while len(kept) >= 2:
            a, b = kept[-2], kept[-1]
            if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0:
                kept.pop()
            else:
                break
        if kept and kept[-1][0] == p[0]:
            if p[1] > kept[-1][1]:
                kept[-1] = p
            continue
        kept.append(p)
    return np.array(kept)


def hull_vertices(roc: DataFrame, slices: int | None = None) -> DataFrame:
    """The points of a ROC table that can be on the upper hull of their group, exactly: a vertex of
    the whole hull is a vertex of the hull of its slice of FPR. A task holds one slice, not a group;
    there are as many slices as the session has shuffle partitions (at most 1024)."""
    slices = slices or min(1024, int(roc.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def of_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[["fpr", "tpr", "threshold"]].to_numpy(dtype=float)
        hull = _hull(pts[np.lexsort((pts[:, 1], pts[:, 0]))])
        first = pdf.iloc[0]
        return pd.DataFrame(
            {"grp": first["grp"], "fpr": hull[:, 0], "tpr": hull[:, 1], "threshold": hull[:, 2],
             "pos_all": float(first["pos_all"]), "neg_all": float(first["neg_all"])}
        )

    part = F.least(F.floor(F.col("fpr") * slices), F.lit(slices - 1)).cast("int")
    rows = roc.select("grp", "fpr", "tpr", "threshold", "pos_all", "neg_all", part.alias("slice"))
    schema = "grp string, fpr double, tpr double, threshold double, pos_all double, neg_all double"
    return rows.groupBy("grp", "slice").applyInPandas(of_slice, schema)


def _group_envelope(grid: int):
    xs = np.linspace(0.0, 1.0, grid + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[["fpr", "tpr", "threshold"]].to_numpy(dtype=float)
        pts = np.vstack([[0.0, 0.0, np.inf], pts, [1.0, 1.0, -np.inf]])
        hull = _hull(pts[np.lexsort((pts[:, 1], pts[:, 0]))])
        right = np.clip(np.searchsorted(hull[:, 0], xs, side="left"), 1, len(hull) - 1)
        left = right - 1
        span = hull[right, 0] - hull[left, 0]
        p1 = np.where(span > 0, (xs - hull[left, 0]) / np.where(span > 0, span, 1.0), 1.0)
        y = (1 - p1) * hull[left, 1] + p1 * hull[right, 1]
        return pd.DataFrame(
            {
                "grp": pdf["grp"].iloc[0], "i": np.arange(grid + 1), "x": xs, "y": y, "p0": 1 - p1,
                "threshold0": hull[left, 2], "p1": p1, "threshold1": hull[right, 2],
                "pos": float(pdf["pos_all"].iloc[0]), "neg": float(pdf["neg_all"].iloc[0]),
            }
        )

    return run


def equalized_odds_rule(val: DataFrame, grid: int = 1000) -> DataFrame:
    """Mixing rule that gives every group the same (FPR, TPR) on the tuning rows.

    Every distinct score is a point of the ROC table; its upper hull is taken in slices and then
    whole (:func:`hull_vertices`) and read at a common grid of FPR values; the lowest hull at each value is reachable by all groups, and the
    grid point with the best accuracy wins. Tuning rows must not hold test rows.
    """
    if "split" in val.columns:
        require_no_holdout(val)
    val = stored(val.select("grp", "y_true", "y_prob"))  # the ROC table reads it four times
    roc = hull_vertices(roc_curve(val).filter("pos_all > 0 AND neg_all > 0"))
    schema = "grp string, i int, x double, y double, p0 double, threshold0 double, p1 double, threshold1 double, pos double, neg double"
    env = stored(roc.groupBy("grp").applyInPandas(_group_envelope(grid), schema))
    per_x = env.groupBy("i", "x").agg(
        F.min("y").alias("y_all"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    accuracy = (F.col("pos") * F.col("y_all") + F.col("neg") * (1.0 - F.col("x"))) / (F.col("pos") + F.col("neg"))
    best = per_x.agg(F.max_by(F.struct("i", "y_all"), F.struct(accuracy, -F.col("i"))).alias("b")).first()["b"]
    if best is None:
        return val.sparkSession.createDataFrame([], RULE)
    x_best, y_best = best["i"] / grid, best["y_all"]
    over = F.col("y") - F.lit(y_best)
    room = F.col("y") - F.col("x")
    return env.filter(F.col("i") == best["i"]).select(
        "grp",
        F.when(room > 1e-12, F.greatest(F.lit(0.0), over / room)).otherwise(0.0).alias("p_ignore"),
        F.lit(x_best).alias("prediction_constant"),
        "p0",
        "threshold0",
        "p1",
        "threshold1",
    )


def apply_mixing(df: DataFrame, rule: DataFrame, row_id: str = "row_id", seed: int = 42, default: float = 0.5) -> DataFrame:
    """Decide with a mixing rule. The coin of a row is a keyed draw, so decisions repeat."""
    joined = attach(df, rule, ["grp"])
    hit = lambda t: (F.col("y_prob") >= F.col(t)).cast("double")
    mixed = F.col("p0") * hit("threshold0") + F.col("p1") * hit("threshold1")
    chance = F.col("p_ignore") * F.col("prediction_constant") + (1.0 - F.col("p_ignore")) * mixed
    coin = draw32(F.lit(f"{seed}m"), row_id) / F.lit(float(2**32))
    decided = F.when(F.col("p_ignore").isNull(), (F.col("y_prob") >= default).cast("int")).otherwise(
        (coin < chance).cast("int")
    )
    return (
        joined.withColumn("decision_chance", chance)
        .withColumn("y_pred", decided)
        .drop("p_ignore", "prediction_constant", "p0", "threshold0", "p1", "threshold1")
    )
