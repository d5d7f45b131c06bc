"""Confusion cells, rates, disparities, calibration, ROC area, collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.catalog.registry import (
    CELLS, DOC_SQL, EVENT_SQL, GAP4, LINE_SQL, ORDER_SQL, TOTAL, cells_sql, disparity_sql, document_frame,
    event_frame, line_frame, order_frame, query, rates_sql,
)
from evenhand.operators import calibration as K
from evenhand.operators import metrics as M
from evenhand.operators.cells import calibration_cells, confusion_cells, merge_cells
from evenhand.operators.units import IntersectionSpec, with_intersection

COUNTS = ["n", "pos_n", "neg_n", "sel_n", "tn", "fp", "fn", "tp"]


@query("confusion_by_group", f"WITH {LINE_SQL} SELECT grp, {CELLS} FROM L GROUP BY grp")
def confusion_by_group(spark, sf):
    return confusion_cells(line_frame(spark, sf))


@query(
    "subgroup_rates",
    f"""WITH {LINE_SQL}, {cells_sql("L")}, {rates_sql()}
SELECT grp, n, tp + fn AS positive_count, tn + fp AS negative_count, tn, fp, fn, tp, positive_prevalence,
       selection_rate, tpr, tnr, fpr, fnr, ppv, (tpr + tnr) / 2.0 AS balanced_accuracy,
       CASE WHEN n < 5 THEN 'INSUFFICIENT_GROUP_SUPPORT' ELSE 'VALID' END AS support_status
FROM R""",
)
def subgroup_rates(spark, sf):
    return M.subgroup_table(confusion_cells(line_frame(spark, sf))).drop("pos_n", "neg_n", "sel_n")


INTERSECTION = IntersectionSpec(["lang", "source"], min_group_size=20)
SPARSE_SQL = f"""WITH {DOC_SQL}, DX AS (SELECT * REPLACE (concat(lang, ' x ', source) AS grp) FROM D),
{cells_sql("DX")}, {rates_sql()}"""


@query(
    "sparse_subgroup_support",
    f"""{SPARSE_SQL}
SELECT grp, n, tp + fn AS positive_count, tn + fp AS negative_count, selection_rate, tpr, fpr, ppv,
  CASE WHEN n < 20 OR tp + fn < 5 OR tn + fp < 5 THEN 'INSUFFICIENT_GROUP_SUPPORT' ELSE 'VALID' END
    AS support_status
FROM R""",
)
def sparse_subgroup_support(spark, sf):
    cells = confusion_cells(with_intersection(document_frame(spark, sf), INTERSECTION))
    return M.subgroup_table(cells, M.Gates(20, 5, 5)).select(
        "grp", "n", "positive_count", "negative_count", "selection_rate", "tpr", "fpr", "ppv", "support_status"
    )


WIDE = [f"{s}_{k}" for s in ("dp", "eo", "eodds", "pp", "di") for k in ("value", "status")]


def _wide(frame, gates=M.Gates()):
    return M.disparity_wide(confusion_cells(frame), gates)


@query(
    "disparity_summary",
    f"""WITH {LINE_SQL}, {cells_sql("L")}, {rates_sql()}, {disparity_sql()}
SELECT groups, {", ".join(WIDE)} FROM W""",
)
def disparity_summary(spark, sf):
    return _wide(line_frame(spark, sf)).select("groups", *WIDE)


@query(
    "disparity_rows",
    f"""WITH {EVENT_SQL}, {cells_sql("E")}, {rates_sql()}, {disparity_sql()}
SELECT 'Demographic Parity Diff' AS metric, dp_value AS value, dp_status AS status FROM W UNION ALL
SELECT 'Equal Opportunity Diff', eo_value, eo_status FROM W UNION ALL
SELECT 'Equalized Odds Diff', eodds_value, eodds_status FROM W UNION ALL
SELECT 'Predictive Parity Diff', pp_value, pp_status FROM W UNION ALL
SELECT 'Disparate Impact Ratio', di_value, di_status FROM W""",
)
def disparity_rows(spark, sf):
    return M.disparity_rows(_wide(event_frame(spark, sf))).select("metric", "value", "status")


@query(
    "sparse_disparities",
    f"""{SPARSE_SQL}, {disparity_sql(size=2, positives=1, negatives=1, di_size=1)}
SELECT groups, {", ".join(WIDE)} FROM W""",
)
def sparse_disparities(spark, sf):
    """Intersections with tiny groups: every status of the precedence chain can come up."""
    frame = with_intersection(document_frame(spark, sf), INTERSECTION)
    return _wide(frame, M.Gates(2, 1, 1, ratio_size=1)).select("groups", *WIDE)


@query(
    "disparities_by_source",
    f"""WITH {DOC_SQL}, C AS (SELECT source, lang AS grp, {CELLS} FROM D GROUP BY source, lang), {rates_sql()},
{disparity_sql(by="source", size=1)}
SELECT source, groups, {", ".join(WIDE)} FROM W""",
)
def disparities_by_source(spark, sf):
    """One audit per source at once; sources without positives or negatives show their status."""
    cells = confusion_cells(document_frame(spark, sf), ("source", "grp"))
    return M.disparity_wide(cells, M.Gates(1), by=("source",)).select("source", "groups", *WIDE)


def _single(name, short, frame_sql, frame, alias, size=5, positives=0, negatives=0):
    sql = f"""WITH {frame_sql}, {cells_sql(alias)}, {rates_sql()},
{disparity_sql(size=size, positives=positives, negatives=negatives)}
SELECT {short}_value AS value, {short}_status AS status FROM W"""

    @query(name, sql)
    def run(spark, sf):
        wide = _wide(frame(spark, sf), M.Gates(size, positives, negatives))
        return wide.select(F.col(f"{short}_value").alias("value"), F.col(f"{short}_status").alias("status"))

    return run


_single("dp_diff", "dp", ORDER_SQL, order_frame, "O")
_single("eo_diff", "eo", ORDER_SQL, order_frame, "O", positives=5)
_single("eodds_diff", "eodds", EVENT_SQL, event_frame, "E", positives=5, negatives=5)
_single("pp_diff", "pp", EVENT_SQL, event_frame, "E")
_single("di_ratio", "di", DOC_SQL, document_frame, "D", size=1)


@query(
    "di_selection_rates",
    f"""WITH {DOC_SQL}, {cells_sql("D")}, {rates_sql()}, {disparity_sql(size=1)}
SELECT R.grp, R.selection_rate, W.di_status AS status FROM R, W""",
)
def di_selection_rates(spark, sf):
    return M.selection_rate_rows(confusion_cells(document_frame(spark, sf)), M.Gates(1))


@query(
    "di_extreme_groups",
    f"""WITH {DOC_SQL}, C AS (SELECT source, lang AS grp, {CELLS} FROM D GROUP BY source, lang), {rates_sql()}
SELECT source, arg_min(grp, (selection_rate, grp)) AS lowest_group, arg_min(grp, (-selection_rate, grp)) AS highest_group FROM R GROUP BY source""",
)
def di_extreme_groups(spark, sf):
    """Who stands at both ends of the ratio, per source."""
    cells = confusion_cells(document_frame(spark, sf), ("source", "grp"))
    return M.disparity_wide(cells, M.Gates(1), by=("source",)).select("source", "lowest_group", "highest_group")


PERFORMANCE = """
  (tp + tn) / n AS accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2.0 AS balanced_accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0.0) AS f1_score"""


@query(
    "global_performance",
    f"""WITH {LINE_SQL}, {cells_sql("L")}, T AS (SELECT {TOTAL} FROM C)
SELECT n, tn, fp, fn, tp, {PERFORMANCE}, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr,
  fp / nullif(tn + fp, 0) AS fpr, fn / nullif(tp + fn, 0) AS fnr, tp / nullif(tp + fp, 0) AS ppv,
  (tp + fp) / n AS positive_prediction_rate, (tp + fn) / n AS actual_positive_prevalence FROM T""",
)
def global_performance(spark, sf):
    return M.global_performance(merge_cells(confusion_cells(line_frame(spark, sf))))


@query(
    "performance_rows",
    f"""WITH {DOC_SQL}, {cells_sql("D")}, T AS (SELECT {TOTAL} FROM C), P AS (
  SELECT *, {PERFORMANCE}, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr,
  fp / nullif(tn + fp, 0) AS fpr, fn / nullif(tp + fn, 0) AS fnr, tp / nullif(tp + fp, 0) AS ppv FROM T)
SELECT * FROM (
  SELECT 'Accuracy' AS metric, accuracy AS value, 'VALID' AS status FROM P UNION ALL
  SELECT 'Balanced Accuracy', balanced_accuracy, 'VALID' FROM P UNION ALL
  SELECT 'Precision', precision, 'VALID' FROM P UNION ALL SELECT 'Recall', recall, 'VALID' FROM P UNION ALL
  SELECT 'F1-Score', f1_score, 'VALID' FROM P UNION ALL
  SELECT 'TP', CAST(tp AS DOUBLE), 'VALID' FROM P UNION ALL SELECT 'TN', CAST(tn AS DOUBLE), 'VALID' FROM P UNION ALL
  SELECT 'FP', CAST(fp AS DOUBLE), 'VALID' FROM P UNION ALL SELECT 'FN', CAST(fn AS DOUBLE), 'VALID' FROM P UNION ALL
  SELECT 'TPR', tpr, CASE WHEN tpr IS NULL THEN 'ZERO_POSITIVE_SUBGROUP' ELSE 'VALID' END FROM P UNION ALL
  SELECT 'TNR', tnr, CASE WHEN tnr IS NULL THEN 'ZERO_NEGATIVE_SUBGROUP' ELSE 'VALID' END FROM P UNION ALL
  SELECT 'FPR', fpr, CASE WHEN fpr IS NULL THEN 'ZERO_NEGATIVE_SUBGROUP' ELSE 'VALID' END FROM P UNION ALL
  SELECT 'FNR', fnr, CASE WHEN fnr IS NULL THEN 'ZERO_POSITIVE_SUBGROUP' ELSE 'VALID' END FROM P UNION ALL
  SELECT 'PPV', ppv, CASE WHEN ppv IS NULL THEN 'UNDEFINED' ELSE 'VALID' END FROM P UNION ALL
  SELECT 'Positive Prediction Rate', (tp + fp) / n, 'VALID' FROM P UNION ALL
  SELECT 'Actual Positive Prevalence', (tp + fn) / n, 'VALID' FROM P)""",
)
def performance_rows(spark, sf):
    return M.performance_rows(merge_cells(confusion_cells(document_frame(spark, sf))))


def weighted_cells_sql(frame: str, w: str) -> str:
    """Raw support counts next to weighted cells."""
    def cell(y, p):
        return f"sum(CASE WHEN y_true = {y} AND y_pred = {p} THEN CAST({w} AS DOUBLE) ELSE 0.0 END)"

    return f"""C AS (SELECT grp, count(*) AS n,
  CAST(sum(y_true) AS BIGINT) AS pos_n, CAST(sum(1 - y_true) AS BIGINT) AS neg_n, CAST(sum(y_pred) AS BIGINT) AS sel_n,
  {cell(0, 0)} AS tn, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(1, 1)} AS tp FROM {frame} GROUP BY grp)"""


@query(
    "weighted_confusion",
    f"""WITH {LINE_SQL}, {weighted_cells_sql("L", "weight")}
SELECT grp, n, pos_n, neg_n, sel_n, round(tn, 4) AS tn, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tp, 4) AS tp
FROM C""",
)
def weighted_confusion(spark, sf):
    c = confusion_cells(line_frame(spark, sf), weight="weight")
    return c.select("grp", "n", "pos_n", "neg_n", "sel_n", *[F.round(x, 4).alias(x) for x in ("tn", "fp", "fn", "tp")])


@query(
    "weighted_disparities",
    f"""WITH {LINE_SQL}, {weighted_cells_sql("L", "weight")}, {rates_sql()}, {disparity_sql(positives=5, negatives=5)}
SELECT round(dp_value, 8) AS dp_value, dp_status, round(eo_value, 8) AS eo_value, eo_status,
  round(eodds_value, 8) AS eodds_value, eodds_status, round(pp_value, 8) AS pp_value, pp_status,
  round(di_value, 8) AS di_value, di_status FROM W""",
)
def weighted_disparities(spark, sf):
    cells = confusion_cells(line_frame(spark, sf), weight="weight")
    wide = M.disparity_wide(cells, M.Gates(5, 5, 5), weighted=True)
    return wide.select(*[F.round(c, 8).alias(c) if c.endswith("value") else F.col(c) for c in WIDE])


LEGACY = f"""WITH {LINE_SQL}, {cells_sql("L")}, {rates_sql()},
Z AS (SELECT selection_rate AS s, coalesce(tpr, 0) AS t, coalesce(fpr, 0) AS f, coalesce(ppv, 0) AS p FROM R)"""


@query("legacy_di_positive_only", f"{LEGACY} SELECT min(s) FILTER (WHERE s > 0) / max(s) AS di_positive_only FROM Z")
def legacy_di_positive_only(spark, sf):
    return M.legacy_disparities(confusion_cells(line_frame(spark, sf))).select("di_positive_only")


@query("legacy_di_raw", f"{LEGACY} SELECT CASE WHEN max(s) > 0 THEN min(s) / max(s) END AS di_raw FROM Z")
def legacy_di_raw(spark, sf):
    return M.legacy_disparities(confusion_cells(line_frame(spark, sf))).select("di_raw")


@query(
    "legacy_pp",
    f"""WITH {DOC_SQL}, C AS (SELECT source, lang AS grp, {CELLS} FROM D GROUP BY source, lang), {rates_sql()}
SELECT source, CASE WHEN count(*) >= 2 THEN max(coalesce(ppv, 0)) - min(coalesce(ppv, 0)) END AS pp_value
FROM R GROUP BY source""",
)
def legacy_pp(spark, sf):
    cells = confusion_cells(document_frame(spark, sf), ("source", "grp"))
    return M.legacy_disparities(cells, ("source",)).select("source", "pp_value")


@query(
    "legacy_metric_set",
    f"""{LEGACY}, T AS (SELECT {TOTAL} FROM C), P AS (SELECT {PERFORMANCE} FROM T),
X AS (SELECT max(s) - min(s) AS dp, max(t) - min(t) AS eo, greatest(max(t) - min(t), max(f) - min(f)) AS odds,
             max(p) - min(p) AS pp, min(s) / max(s) AS di FROM Z)
SELECT P.*, dp AS dp_value, eo AS eo_value, odds AS eodds_value, pp AS pp_value, di AS di_raw,
  (dp + eo + odds) / 3 AS gap_three, (dp + eo + odds + pp) / 4 AS gap_four,
  balanced_accuracy - 0.25::DOUBLE * ((dp + eo + odds + pp) / 4) AS candidate_score FROM P, X""",
)
def legacy_metric_set(spark, sf):
    cells = confusion_cells(line_frame(spark, sf)).withColumn("all", F.lit(1))
    left = merge_cells(cells, ("all",)).select("all", *M.performance_columns())
    out = left.join(M.legacy_disparities(cells, ("all",)), "all")
    gap = M.fairness_gap()
    return out.select(
        "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "dp_value", "eo_value", "eodds_value",
        "pp_value", "di_raw", M.fairness_gap(("dp", "eo", "eodds")).alias("gap_three"), gap.alias("gap_four"),
        M.utility_score("balanced_accuracy", gap).alias("candidate_score"),
    )


@query(
    "fairness_gap_utility",
    f"""{SPARSE_SQL}, {disparity_sql(size=1)}, T AS (SELECT {TOTAL} FROM C), P AS (SELECT {PERFORMANCE} FROM T),
X AS (SELECT *, {GAP4} AS gap FROM W)
SELECT gap AS fairness_gap, balanced_accuracy - 0.25::DOUBLE * coalesce(gap, 0.5) AS utility_score,
  greatest(0.0, 0.75::DOUBLE - accuracy) AS accuracy_tradeoff,
  CASE WHEN dp_status <> 'VALID' OR eo_status <> 'VALID' OR eodds_status <> 'VALID' OR di_status <> 'VALID'
       THEN 'UNDEFINED' ELSE 'VALID' END AS overall_status
FROM P, X""",
)
def fairness_gap_utility(spark, sf):
    frame = with_intersection(document_frame(spark, sf), INTERSECTION).withColumn("all", F.lit(1))
    cells = confusion_cells(frame, ("all", "grp"))
    left = merge_cells(cells, ("all",)).select("all", *M.performance_columns())
    wide = M.disparity_wide(cells, M.Gates(1), by=("all",))
    out = left.join(wide, "all").withColumn("fairness_gap", M.fairness_gap())
    return out.select(
        "fairness_gap",
        M.utility_score("balanced_accuracy", "fairness_gap").alias("utility_score"),
        M.accuracy_tradeoff(F.lit(0.75), F.col("accuracy")).alias("accuracy_tradeoff"),
        M.overall_status(F.lit(V.VALID)).alias("overall_status"),
    )


@query(
    "operating_point",
    f"""WITH {DOC_SQL}, DX AS (SELECT * REPLACE (source AS grp) FROM D), {cells_sql("DX")}
SELECT grp, coalesce(fp / nullif(fp + tn, 0), 0.0) AS fpr, coalesce(tp / nullif(tp + fn, 0), 0.0) AS tpr FROM C""",
)
def operating_point(spark, sf):
    frame = document_frame(spark, sf).withColumn("grp", F.col("source"))
    return M.operating_point(confusion_cells(frame), ("grp",))


COLLAPSE = """
CASE WHEN tp + fp = 0 OR tn + fn = 0 OR (tp + fp) / n <= 0.02 OR (tp + fp) / n >= 0.98 THEN 'DEGENERATE'
     WHEN -((1.0 - (tp + fp) / n) * log2(1.0 - (tp + fp) / n) + ((tp + fp) / n) * log2((tp + fp) / n)) < 0.1
       THEN 'DEGENERATE'
     WHEN abs((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2.0 - 0.5) < 0.015
       AND CASE WHEN tp + fn > tn + fp THEN (tp + fp) / n ELSE (tn + fn) / n END > 0.85 THEN 'INSUFFICIENT_SIGNAL'
     ELSE 'NORMAL' END"""


@query(
    "prediction_collapse",
    f"""WITH {DOC_SQL}, DX AS (SELECT * REPLACE (source AS grp) FROM D), {cells_sql("DX")}
SELECT grp, (tp + fp) / n AS prediction_rate, {COLLAPSE} AS degeneracy_status FROM C""",
)
def prediction_collapse(spark, sf):
    """Each source as its own predictor: small ones collapse."""
    frame = document_frame(spark, sf).withColumn("grp", F.col("source"))
    return M.prediction_collapse(confusion_cells(frame), ("grp",)).drop("degeneracy_message")


@query(
    "brier_by_group",
    f"WITH {EVENT_SQL} SELECT grp, round(avg((y_prob - y_true) ** 2), 8) AS brier_score FROM E GROUP BY grp",
)
def brier_by_group(spark, sf):
    out = K.brier(calibration_cells(event_frame(spark, sf), ("grp",)), ("grp",))
    return out.select("grp", F.round("brier_score", 8).alias("brier_score"))


EDGES = "[0.0,0.1,0.2,0.30000000000000004,0.4,0.5,0.6000000000000001,0.7000000000000001,0.8,0.9,1.0]::DOUBLE[]"


def bins_sql(frame: str, by: str = "") -> str:
    """Reliability bins by comparing with the edge list."""
    lead = f"{by}, " if by else ""
    return f"""edges AS (SELECT i AS bin, ({EDGES})[i + 1] AS lo, ({EDGES})[i + 2] AS hi FROM range(10) t(i)),
B AS (SELECT {lead} e.bin, count(*) AS n, sum(y_true) AS pos, sum(y_prob) AS s FROM {frame} f JOIN edges e
      ON f.y_prob >= e.lo AND (f.y_prob < e.hi OR (e.bin = 9 AND f.y_prob <= e.hi)) GROUP BY {lead} e.bin)"""


@query(
    "ece_bins",
    f"""WITH {EVENT_SQL}, {bins_sql("E")}
SELECT CAST(e.bin AS INT) AS bin, e.lo AS bin_low, e.hi AS bin_high, coalesce(n, 0) AS bin_size,
  round(coalesce(pos / n, 0.0), 8) AS bin_accuracy, round(coalesce(s / n, 0.0), 8) AS bin_confidence,
  round(coalesce(abs(pos / n - s / n), 0.0), 8) AS bin_gap FROM edges e LEFT JOIN B ON e.bin = B.bin""",
)
def ece_bins(spark, sf):
    out = K.reliability_bins(calibration_cells(event_frame(spark, sf)))
    return out.select(
        "bin", "bin_low", "bin_high", "bin_size",
        *[F.round(c, 8).alias(c) for c in ("bin_accuracy", "bin_confidence", "bin_gap")],
    )


@query(
    "calibration_error",
    f"""WITH {EVENT_SQL}, {bins_sql("E")}, N AS (SELECT count(*) AS n, avg((y_prob - y_true) ** 2) AS brier FROM E)
SELECT round(any_value(brier), 7) AS brier_score,
  round(sum((B.n / N.n) * abs(pos / B.n - s / B.n)), 7) AS expected_calibration_error FROM B, N""",
)
def calibration_error(spark, sf):
    out = K.calibration_error(calibration_cells(event_frame(spark, sf)))
    return out.select(*[F.round(c, 7).alias(c) for c in ("brier_score", "expected_calibration_error")])


@query(
    "calibration_by_group",
    f"""WITH {DOC_SQL}, DS AS (SELECT * REPLACE (source AS grp) FROM D), {bins_sql("DS", "grp")},
N AS (SELECT grp, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos, avg((y_prob - y_true) ** 2) AS brier FROM DS GROUP BY grp),
X AS (SELECT grp, sum(abs(pos - s)) AS g FROM B GROUP BY grp),
Y AS (SELECT N.*, coalesce(g, 0) / n AS ece, n < 30 OR pos < 5 OR n - pos < 5 AS thin FROM N LEFT JOIN X USING (grp))
SELECT grp, n AS count, pos AS positive_count, n - pos AS negative_count,
  CASE WHEN thin THEN 'INSUFFICIENT_CALIBRATION_SUPPORT' ELSE 'VALID' END AS calibration_support_status,
  round(CASE WHEN NOT thin THEN brier END, 8) AS brier_score,
  round(CASE WHEN NOT thin THEN ece END, 8) AS expected_calibration_error,
  CASE WHEN thin THEN 'INSUFFICIENT_GROUP_SUPPORT' ELSE 'VALID' END AS status FROM Y""",
)
def calibration_by_group(spark, sf):
    frame = document_frame(spark, sf).withColumn("grp", F.col("source"))
    out = K.group_calibration(calibration_cells(frame, ("grp",)))
    rounded = ("brier_score", "expected_calibration_error")
    return out.select(*[F.round(c, 8).alias(c) if c in rounded else F.col(c) for c in out.columns])


def auc_sql(frame: str, by: str = "") -> str:
    """Rank-sum form of the ROC area with average ranks."""
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""K AS (SELECT {lead} y_true, rank() OVER ({part} ORDER BY y_prob)
       + (count(*) OVER ({'PARTITION BY ' + lead + 'y_prob'}) - 1) / 2.0 AS r FROM {frame}),
S AS (SELECT {lead} sum(r) FILTER (WHERE y_true = 1) AS rs, sum(y_true) AS p, sum(1 - y_true) AS q FROM K {group})
SELECT {lead} round((rs - p * (p + 1) / 2.0) / nullif(p * q, 0), 8) AS roc_auc,
  CASE WHEN p = 0 OR q = 0 THEN 'DEGENERATE_TARGET' ELSE 'VALID' END AS status FROM S"""


@query("roc_auc", f"WITH {EVENT_SQL}, {auc_sql('E')}")
def roc_auc(spark, sf):
    return K.roc_auc(event_frame(spark, sf)).select(F.round("roc_auc", 8).alias("roc_auc"), "status")


@query("roc_auc_by_group", f"WITH {LINE_SQL}, {auc_sql('L', 'grp')}")
def roc_auc_by_group(spark, sf):
    return K.roc_auc(line_frame(spark, sf), ("grp",)).select("grp", F.round("roc_auc", 8).alias("roc_auc"), "status")


@query(
    "class_balance",
    f"""WITH {LINE_SQL}, T AS (SELECT CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg FROM L)
SELECT pos, neg, (pos + neg) / (2 * pos) AS weight_positive, (pos + neg) / (2 * neg) AS weight_negative,
  greatest(neg / greatest(pos, 1), 1.0) AS positive_scale FROM T""",
)
def class_balance(spark, sf):
    return M.class_balance(line_frame(spark, sf))


@query(
    "majority_baseline",
    f"""WITH {LINE_SQL} SELECT grp, CASE WHEN 2 * sum(y_true) > count(*) THEN 1 ELSE 0 END AS majority_label,
  avg(y_true) AS constant_score FROM L GROUP BY grp""",
)
def majority_baseline(spark, sf):
    return M.majority_class(line_frame(spark, sf), ("grp",))
