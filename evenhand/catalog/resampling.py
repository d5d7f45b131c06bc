"""Bootstrap intervals and negative controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.registry import CELLS, EVENT_SQL, cells_sql, disparity_sql, event_frame, query, rates_sql
from evenhand.operators import resample as B

REPLICATES, CONTROLS = 500, 100
U60 = "('0x' || substr(md5({}), 1, 15))::HUGEINT"

INTERVALS_SQL = f"""
RR AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, fp / nullif(tn + fp, 0) AS fpr,
  tp / nullif(tp + fp, 0) AS ppv, (tp + fp) / nullif(n, 0) AS selection_rate FROM RC),
{disparity_sql("RR", "RW", by="b", size=2)},
V AS (SELECT b, 'Equalized Odds Diff' AS metric, eodds_value AS v FROM RW UNION ALL
  SELECT b, 'Demographic Parity Diff', dp_value FROM RW UNION ALL
  SELECT b, 'Disparate Impact Ratio', di_value FROM RW UNION ALL
  SELECT b, 'Selection Rate (' || grp || ')', selection_rate FROM RR UNION ALL
  SELECT b, 'TPR (' || grp || ')', tpr FROM RR)
SELECT metric, round(quantile_cont(v, 0.025), 8) AS ci_low, round(quantile_cont(v, 0.975), 8) AS ci_high,
  count(v) AS successful, 'VALID' AS support_status FROM V GROUP BY metric"""

REPLICATE_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE cell = '{c}') AS {c}" for c in ("tn", "fp", "fn", "tp")
)


def _shown(out):
    return out.select(
        "metric", F.round("ci_low", 8).alias("ci_low"), F.round("ci_high", 8).alias("ci_high"), "successful",
        "support_status",
    )


@query(
    "bootstrap_ci",
    f"""WITH {EVENT_SQL}, {cells_sql("E")},
DR AS (SELECT t.b, grp, tn, fp, fn, tp, (({U60.format("concat_ws('|', 42, t.b, grp, s.i)")} * n) >> 60)::BIGINT AS u
  FROM C, range({REPLICATES}) t(b), LATERAL (SELECT unnest(range(n)) AS i) s),
DC AS (SELECT b, grp, CASE WHEN u < tn THEN 'tn' WHEN u < tn + fp THEN 'fp' WHEN u < tn + fp + fn THEN 'fn' ELSE 'tp' END AS cell FROM DR),
RQ AS (SELECT b, grp, {REPLICATE_COUNTS} FROM DC GROUP BY b, grp),
RC AS (SELECT *, tn + fp + fn + tp AS n, fn + tp AS pos_n, tn + fp AS neg_n, fp + tp AS sel_n FROM RQ),
{INTERVALS_SQL}""",
)
def bootstrap_ci(spark, sf):
    return _shown(B.bootstrap(event_frame(spark, sf), REPLICATES, method="slots"))


@query("bootstrap_ci_fast")
def bootstrap_ci_fast(spark, sf):
    """Multinomial draws per group: the production form, with 500 replicates."""
    out = B.bootstrap(event_frame(spark, sf), 500, method="cells")
    return out.withColumn("discard_reasons", F.to_json("discard_reasons"))


@query(
    "cluster_bootstrap_ci",
    f"""WITH {EVENT_SQL}, PC AS (SELECT cluster_id, grp, {CELLS} FROM E GROUP BY cluster_id, grp),
ID AS (SELECT cluster_id, row_number() OVER (ORDER BY md5(cluster_id::VARCHAR)) - 1 AS idx
       FROM (SELECT DISTINCT cluster_id FROM PC)),
K AS (SELECT count(*) AS k FROM ID),
DR AS (SELECT t.b, (({U60.format("concat_ws('|', 42, t.b, s.i)")} * k) >> 60)::BIGINT AS idx
  FROM K, range({REPLICATES}) t(b), LATERAL (SELECT unnest(range(k)) AS i) s),
RC AS (SELECT b, grp, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos_n) AS BIGINT) AS pos_n, CAST(sum(neg_n) AS BIGINT) AS neg_n,
  CAST(sum(sel_n) AS BIGINT) AS sel_n, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp
  FROM DR JOIN ID USING (idx) JOIN PC USING (cluster_id) GROUP BY b, grp),
{INTERVALS_SQL}""",
)
def cluster_bootstrap_ci(spark, sf):
    return _shown(B.cluster_bootstrap(event_frame(spark, sf), replicates=REPLICATES, method="slots"))


@query("cluster_bootstrap_ci_fast")
def cluster_bootstrap_ci_fast(spark, sf):
    """Bucketed cluster draws: the production form."""
    out = B.cluster_bootstrap(event_frame(spark, sf), replicates=500, method="cells")
    return out.withColumn("discard_reasons", F.to_json("discard_reasons"))


def _control_sql(dealt: str, name: str, explained: str) -> str:
    return f"""{dealt}, RC AS (SELECT b, grp, {CELLS} FROM DEALT GROUP BY b, grp),
{rates_sql("RC", "RR")}, {disparity_sql("RR", "RW", by="b", size=1)},
{cells_sql("E")}, {rates_sql()}, {disparity_sql(size=1)}
SELECT '{name}' AS control_name, round(any_value(W.dp_value), 8) AS observed_gap, round(avg(RW.dp_value), 8) AS control_mean,
  round(stddev_pop(RW.dp_value), 8) AS control_std,
  avg(CASE WHEN RW.dp_value >= W.dp_value THEN 1.0 ELSE 0.0 END) AS p_value, {explained} AS explained FROM RW, W"""


def _control(out):
    return out.select(
        "control_name",
        *[F.round(c, 8).alias(c) for c in ("observed_gap", "control_mean", "control_std")],
        "p_value",
        "explained",
    )


GROUP_ENDS = """GE AS (SELECT grp, sum(count(*)) OVER (ORDER BY grp) AS hi, sum(count(*)) OVER (ORDER BY grp) - count(*) AS lo
  FROM E GROUP BY grp)"""


@query(
    "permutation_control",
    _control_sql(
        f"""WITH {EVENT_SQL}, {GROUP_ENDS},
PR AS (SELECT b, y_true, y_pred, row_number() OVER (PARTITION BY b ORDER BY md5('42|' || b || '|' || row_id)) AS r
       FROM E, range({CONTROLS}) t(b)),
DEALT AS (SELECT b, y_true, y_pred, GE.grp FROM PR JOIN GE ON r > lo AND r <= hi)""",
        "PERMUTED_SENSITIVE_ATTRIBUTE_CONTROL",
        "avg(CASE WHEN RW.dp_value >= W.dp_value THEN 1.0 ELSE 0.0 END) > 0.05",
    ),
)
def permutation_control(spark, sf):
    return _control(B.permutation_control(event_frame(spark, sf), CONTROLS, method="slots"))


@query("permutation_control_fast")
def permutation_control_fast(spark, sf):
    return B.permutation_control(event_frame(spark, sf), 100)


@query(
    "random_group_control",
    _control_sql(
        f"""WITH {EVENT_SQL}, {GROUP_ENDS}, NN AS (SELECT count(*) AS n FROM E),
PR AS (SELECT b, y_true, y_pred, (({U60.format("'42r|' || b || '|' || row_id")} * n) >> 60)::BIGINT AS u
       FROM E, range({CONTROLS}) t(b), NN),
DEALT AS (SELECT b, y_true, y_pred, GE.grp FROM PR JOIN GE ON u >= lo AND u < hi)""",
        "RANDOM_GROUP_CONTROL",
        "false",
    ),
)
def random_group_control(spark, sf):
    return _control(B.random_group_control(event_frame(spark, sf), CONTROLS, method="slots"))


@query("random_group_control_fast")
def random_group_control_fast(spark, sf):
    return B.random_group_control(event_frame(spark, sf), 100)


def spread_of_rates(cells, by):
    """A caller's metric: mean distance of a group's selection rate from the overall one, weighted by rows."""
    total = cells.groupBy(*by).agg((F.sum("sel_n") / F.sum("n")).alias("all_rate"))
    both = cells.join(total, list(by)) if by else cells.crossJoin(total)
    away = F.col("n") * F.abs(F.col("sel_n") / F.col("n") - F.col("all_rate"))
    return both.groupBy(*by).agg((F.sum(away) / F.sum("n")).alias("gap"))


@query(
    "custom_metric_control",
    f"""WITH {EVENT_SQL}, {GROUP_ENDS}, NN AS (SELECT count(*) AS n FROM E),
PR AS (SELECT b, y_true, y_pred, (({U60.format("'42r|' || b || '|' || row_id")} * n) >> 60)::BIGINT AS u FROM E, range({CONTROLS}) t(b), NN),
DEALT AS (SELECT b, y_pred, GE.grp FROM PR JOIN GE ON u >= lo AND u < hi UNION ALL SELECT -1, y_pred, grp FROM E),
RC AS (SELECT b, grp, count(*) AS n, sum(y_pred) AS s FROM DEALT GROUP BY b, grp),
RG AS (SELECT b, sum(n * abs(s / n - a)) / sum(n) AS gap FROM (SELECT *, sum(s) OVER w / sum(n) OVER w AS a FROM RC WINDOW w AS (PARTITION BY b)) GROUP BY b),
W AS (SELECT gap AS g FROM RG WHERE b = -1)
SELECT 'RANDOM_GROUP_CONTROL' AS control_name, round(any_value(g), 8) AS observed_gap, round(avg(gap), 8) AS control_mean,
  round(stddev_pop(gap), 8) AS control_std, avg(CASE WHEN gap >= g THEN 1.0 ELSE 0.0 END) AS p_value, false AS explained FROM RG, W WHERE b >= 0""",
)
def custom_metric_control(spark, sf):
    return _control(B.random_group_control(event_frame(spark, sf), CONTROLS, metric=spread_of_rates, method="slots"))


@query(
    "feature_group_control",
    f"""WITH {EVENT_SQL}, MD AS (SELECT quantile_cont(value, 0.5) AS m FROM E),
H AS (SELECT y_true, y_pred, CASE WHEN value > m THEN 'High_Feature' ELSE 'Low_Feature' END AS grp FROM E, MD),
{cells_sql("H", "HC")}, {rates_sql("HC", "HR")}, {disparity_sql("HR", "HW", size=1)},
{cells_sql("E")}, {rates_sql()}, {disparity_sql(size=1)}
SELECT 'FEATURE_DERIVED_GROUP_CONTROL' AS control_name, W.dp_value AS observed_gap, HW.dp_value AS control_mean,
  0.0::DOUBLE AS control_std, NULL::DOUBLE AS p_value, true AS explained FROM W, HW""",
)
def feature_group_control(spark, sf):
    return B.feature_group_control(event_frame(spark, sf), "value")


def _law_sql(replicates: int) -> str:
    """Point estimates by SQL; intervals of rates must lie where the normal law puts them."""
    return f"""WITH {EVENT_SQL}, {cells_sql("E")}, {rates_sql()}, {disparity_sql(size=2)},
P AS (SELECT 'Equalized Odds Diff' AS metric, eodds_value AS v, NULL::BOOLEAN AS near FROM W UNION ALL
  SELECT 'Demographic Parity Diff', dp_value, NULL FROM W UNION ALL SELECT 'Disparate Impact Ratio', di_value, NULL FROM W UNION ALL
  SELECT 'Selection Rate (' || grp || ')', selection_rate, true FROM R UNION ALL SELECT 'TPR (' || grp || ')', tpr, true FROM R)
SELECT metric, round(v, 8) AS point_estimate, near, CAST({replicates} AS INTEGER) AS requested, CAST({replicates} AS BIGINT) AS successful,
  CAST(0 AS BIGINT) AS discarded, '{{}}' AS discard_reasons, 'VALID' AS support_status FROM P"""


@query("bootstrap_law", _law_sql(500))
def bootstrap_law(spark, sf):
    """The production bootstrap against what its law fixes: point estimates, counts, and the ends of
    the intervals of rates within 0.6 standard errors of p +- 1.96 se."""
    e = event_frame(spark, sf)
    out = B.bootstrap(e, 500, method="cells")
    cells = B.confusion_cells(e).select("grp", "n", "pos_n", "sel_n", "tp")
    known = cells.select(F.inline(F.array(
        F.struct(F.concat(F.lit("Selection Rate ("), "grp", F.lit(")")).alias("metric"), (F.col("sel_n") / F.col("n")).alias("p"), F.col("n").alias("m")),
        F.struct(F.concat(F.lit("TPR ("), "grp", F.lit(")")).alias("metric"), (F.col("tp") / F.col("pos_n")).alias("p"), F.col("pos_n").alias("m")),
    )))
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("m"))
    end = lambda c, z: F.abs(F.col(c) - (F.col("p") + z * se)) < 0.6 * se
    both = out.join(known, "metric", "left").withColumn("near", end("ci_low", -1.96) & end("ci_high", 1.96))
    return both.select(
        "metric", F.round("point_estimate", 8).alias("point_estimate"), "near", "requested", "successful", "discarded",
        F.to_json("discard_reasons").alias("discard_reasons"), "support_status",
    )


@query("cluster_bootstrap_law", _law_sql(500))
def cluster_bootstrap_law(spark, sf):
    """The production cluster bootstrap against its law: the spread of a rate is that of the clusters' own residuals."""
    e = event_frame(spark, sf)
    out = B.cluster_bootstrap(e, replicates=500, method="cells")
    per = B.cluster_cells(e).select("cluster_id", "grp", "n", "pos_n", "sel_n", "tp")
    rates = per.groupBy("grp").agg(
        (F.sum("sel_n") / F.sum("n")).alias("p_s"), F.sum("n").alias("m_s"), (F.sum("tp") / F.sum("pos_n")).alias("p_t"), F.sum("pos_n").alias("m_t")
    )
    spread = per.join(rates, "grp").groupBy("grp", "p_s", "m_s", "p_t", "m_t").agg(
        (F.sqrt(F.sum(F.pow(F.col("sel_n") - F.col("p_s") * F.col("n"), 2))) / F.col("m_s")).alias("se_s"),
        (F.sqrt(F.sum(F.pow(F.col("tp") - F.col("p_t") * F.col("pos_n"), 2))) / F.col("m_t")).alias("se_t"),
    )
    known = spread.select(F.inline(F.array(
        F.struct(F.concat(F.lit("Selection Rate ("), "grp", F.lit(")")).alias("metric"), F.col("p_s").alias("p"), F.col("se_s").alias("se")),
        F.struct(F.concat(F.lit("TPR ("), "grp", F.lit(")")).alias("metric"), F.col("p_t").alias("p"), F.col("se_t").alias("se")),
    )))
    end = lambda c, z: F.abs(F.col(c) - (F.col("p") + z * F.col("se"))) < 0.6 * F.col("se")
    both = out.join(known, "metric", "left").withColumn("near", end("ci_low", -1.96) & end("ci_high", 1.96))
    return both.select(
        "metric", F.round("point_estimate", 8).alias("point_estimate"), "near", "requested", "successful", "discarded",
        F.to_json("discard_reasons").alias("discard_reasons"), "support_status",
    )


@query(
    "permutation_margins",
    f"""WITH {EVENT_SQL}, {cells_sql("E")}, T AS (SELECT CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM C)
SELECT CAST(b AS INTEGER) AS b, grp, n, T.tn, T.fp, T.fn, T.tp FROM C, T, range(100) t(b)""",
)
def permutation_margins(spark, sf):
    """The production permutations: every replicate keeps the group sizes and the cell totals."""
    reps = B.permuted_replicates_cells(event_frame(spark, sf), 100)
    totals = reps.groupBy("b").agg(*[F.sum(c).alias(c) for c in B.CELL_NAMES])
    return reps.select("b", "grp", "n").join(totals, "b")


@query(
    "random_group_margins",
    f"""WITH {EVENT_SQL}, {cells_sql("E")} SELECT CAST(b AS INTEGER) AS b, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM C, range(100) t(b) GROUP BY b""",
)
def random_group_margins(spark, sf):
    """The production random groups: every replicate keeps the cell totals."""
    reps = B.random_group_replicates_cells(event_frame(spark, sf), 100)
    return reps.groupBy("b").agg(*[F.sum(c).alias(c) for c in B.CELL_NAMES])
