"""Ranks, bins, splits, folds, Pareto frontier, nearest match, redaction order."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.registry import (
    DOC_SQL, EVENT_SQL, LINE_SQL, ORDER_SQL, cells_sql, document_frame, event_frame, line_frame, order_frame, query,
    rates_sql, table,
)
from evenhand.catalog.metric_core import INTERSECTION, SPARSE_SQL
from evenhand.operators import frames as R
from evenhand.operators import metrics as M
from evenhand.operators import ranking as K
from evenhand.operators import splits as S
from evenhand.operators.cells import confusion_cells
from evenhand.operators.units import with_intersection

AVG_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query(
    "pct_rank",
    f"SELECT event_id, round({AVG_RANK.format(c='value')}, 9) AS pct_rank FROM events",
)
def pct_rank(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return K.percent_ranks(e, "value").select("event_id", F.round("pct_rank", 9).alias("pct_rank"))


@query(
    "pct_rank_signal",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(0.5::DOUBLE * {AVG_RANK.format(c='l_quantity')}
  + 0.3::DOUBLE * {AVG_RANK.format(c='l_discount')} + 0.2::DOUBLE * {AVG_RANK.format(c='l_extendedprice')}, 8) AS signal
FROM lineitem""",
)
def pct_rank_signal(spark, sf):
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice"
    )
    out = K.rank_signal(l, {"l_quantity": 0.5, "l_discount": 0.3, "l_extendedprice": 0.2})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("signal", 8).alias("signal"))


LEVELS = ["Low", "Mid-Low", "Mid-High", "High"]


@query(
    "quartile_bins",
    """WITH X AS (SELECT event_id, row_number() OVER (ORDER BY value, md5(event_id::VARCHAR)) AS r, count(*) OVER () AS n
  FROM events)
SELECT event_id, CASE WHEN r <= 1 + (n - 1) / 4 THEN 'Low' WHEN r <= 1 + (n - 1) * 2 / 4 THEN 'Mid-Low'
  WHEN r <= 1 + (n - 1) * 3 / 4 THEN 'Mid-High' ELSE 'High' END AS quartile FROM X""",
)
def quartile_bins(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return K.quartile_labels(e, "value", "event_id", LEVELS).select("event_id", "quartile")


@query(
    "quartile_bins_ties",
    """WITH X AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 3, md5(o_orderkey::VARCHAR)) AS r,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= 1 + (n - 1) / 4 THEN 'Low' WHEN r <= 1 + (n - 1) * 2 / 4 THEN 'Mid-Low'
  WHEN r <= 1 + (n - 1) * 3 / 4 THEN 'Mid-High' ELSE 'High' END AS quartile FROM X""",
)
def quartile_bins_ties(spark, sf):
    """Three values only, each with a third of the rows: the cuts fall inside ties."""
    o = table(spark, sf, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(3)).alias("v"))
    return K.quartile_labels(o, "v", "o_orderkey", LEVELS).select("o_orderkey", "quartile")


@query(
    "cut_bins",
    """SELECT CASE WHEN hour(ts) > -1 AND hour(ts) <= 6 THEN 'Night' WHEN hour(ts) > 6 AND hour(ts) <= 12 THEN 'Morning'
  WHEN hour(ts) > 12 AND hour(ts) <= 18 THEN 'Afternoon' ELSE 'nan' END AS part, count(*) AS n FROM events GROUP BY 1""",
)
def cut_bins(spark, sf):
    e = table(spark, sf, "events").select(F.hour("ts").alias("h"))
    part = R.fixed_bins("h", [-1, 6, 12, 18], ["Night", "Morning", "Afternoon"])
    return e.select(part.alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# --- splits ------------------------------------------------------------------------------------

SIZES = """greatest(1, CAST(round_even(g * 0.6::DOUBLE, 0) AS BIGINT)) AS a,
  greatest(1, CAST(round_even(g * 0.2::DOUBLE, 0) AS BIGINT)) AS b"""


@query(
    "group_split",
    f"""WITH {LINE_SQL}, U AS (SELECT DISTINCT cluster_id FROM L), N AS (SELECT count(*) AS g FROM U),
Z AS (SELECT {SIZES} FROM N),
P AS (SELECT cluster_id, row_number() OVER (ORDER BY md5('42|' || cluster_id)) AS r FROM U),
X AS (SELECT L.*, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split
      FROM L JOIN P ON L.cluster_id = P.cluster_id, Z)
SELECT split, grp, count(*) AS n, count(DISTINCT cluster_id) AS clusters FROM X GROUP BY split, grp""",
)
def group_split(spark, sf):
    out = S.group_split(line_frame(spark, sf), "cluster_id")
    return out.groupBy("split", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cluster_id").alias("clusters")
    )


@query(
    "group_split_rows",
    """WITH U AS (SELECT DISTINCT user_id FROM events), N AS (SELECT count(*) AS g FROM U),
Z AS (SELECT greatest(1, CAST(round_even(g * 0.6::DOUBLE, 0) AS BIGINT)) AS a,
             greatest(1, CAST(round_even(g * 0.2::DOUBLE, 0) AS BIGINT)) AS b FROM N),
P AS (SELECT user_id, row_number() OVER (ORDER BY md5('7|' || user_id)) AS r FROM U)
SELECT event_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split
FROM events e JOIN P ON e.user_id = P.user_id, Z""",
)
def group_split_rows(spark, sf):
    out = S.group_split(table(spark, sf, "events").select("event_id", "user_id"), "user_id", seed=7)
    return out.select("event_id", "split")


@query(
    "temporal_split",
    """WITH X AS (SELECT event_id, row_number() OVER (ORDER BY ts, md5(event_id::VARCHAR)) AS r, count(*) OVER () AS n
  FROM events)
SELECT event_id, CASE WHEN r <= round_even(n * 0.6::DOUBLE, 0) THEN 'train'
  WHEN r <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM X""",
)
def temporal_split(spark, sf):
    out = S.temporal_split(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")
    return out.select("event_id", "split")


@query(
    "temporal_split_ties",
    """WITH X AS (SELECT o_orderkey, row_number() OVER (ORDER BY date_trunc('year', o_orderdate), md5(o_orderkey::VARCHAR)) AS r,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= round_even(n * 0.6::DOUBLE, 0) THEN 'train'
  WHEN r <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM X""",
)
def temporal_split_ties(spark, sf):
    """Time stamps rounded to years: both cuts fall inside a tie."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_trunc("year", "o_orderdate").alias("t"))
    return S.temporal_split(o, "t", "o_orderkey").select("o_orderkey", "split")


@query(
    "temporal_order_check",
    """WITH X AS (SELECT ts, row_number() OVER (ORDER BY ts, md5(event_id::VARCHAR)) AS r, count(*) OVER () AS n FROM events),
Y AS (SELECT ts, CASE WHEN r <= round_even(n * 0.6::DOUBLE, 0) THEN 'train'
  WHEN r <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM X)
SELECT split, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM Y GROUP BY split""",
)
def temporal_order_check(spark, sf):
    out = S.temporal_split(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")
    S.verify_temporal_order(out, "ts")
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "stratified_split",
    f"""WITH {ORDER_SQL}, X AS (SELECT row_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || row_id)) AS r,
  count(*) OVER (PARTITION BY y_true) AS n FROM O)
SELECT row_id, y_true, CASE WHEN r <= round_even(n * 0.6::DOUBLE, 0) THEN 'train'
  WHEN r <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM X""",
)
def stratified_split(spark, sf):
    out = S.stratified_split(order_frame(spark, sf), "y_true", "row_id")
    return out.select("row_id", "y_true", "split")


@query(
    "holdout_80_20",
    f"""WITH {DOC_SQL}, X AS (SELECT row_id, row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || row_id)) AS r,
  count(*) OVER (PARTITION BY y_true) AS n FROM D)
SELECT row_id, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' ELSE 'test' END AS split FROM X""",
)
def holdout_80_20(spark, sf):
    return S.holdout_80_20(document_frame(spark, sf), "y_true", "row_id").select("row_id", "split")


@query(
    "cv_folds",
    f"""WITH {EVENT_SQL}, X AS (SELECT row_id, row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || row_id)) AS r,
  count(*) OVER (PARTITION BY y_true) AS n FROM E)
SELECT row_id, CAST(((r - 1) * 5) // n AS INT) AS fold FROM X""",
)
def cv_folds(spark, sf):
    return S.stratified_folds(event_frame(spark, sf), "y_true", "row_id", k=5).select("row_id", "fold")


@query(
    "stratified_sample",
    f"""WITH {EVENT_SQL}, C AS (SELECT y_true, count(*) AS n, (SELECT count(*) FROM E) AS t FROM E GROUP BY y_true),
A AS (SELECT y_true, n, 777 * n / t AS x, floor(777 * n / t) AS f FROM C),
B AS (SELECT *, row_number() OVER (ORDER BY x - f DESC, y_true) AS p, 777 - sum(f) OVER () AS rest FROM A),
X AS (SELECT row_id, E.y_true, row_number() OVER (PARTITION BY E.y_true ORDER BY md5('42|' || row_id)) AS r FROM E)
SELECT row_id, X.y_true FROM X JOIN B ON X.y_true = B.y_true WHERE r <= f + CASE WHEN p <= rest THEN 1 ELSE 0 END""",
)
def stratified_sample(spark, sf):
    out = S.stratified_sample(event_frame(spark, sf), "y_true", "row_id", cap=777)
    return out.select("row_id", "y_true")


@query(
    "split_isolation",
    """SELECT CASE WHEN splits = 1 THEN 'isolated' ELSE 'crossing' END AS verdict, count(*) AS groups FROM
(SELECT user_id, count(DISTINCT event_type) AS splits FROM events GROUP BY user_id) GROUP BY 1""",
)
def split_isolation(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    per = e.groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    verdict = F.when(F.col("a") == F.col("b"), "isolated").otherwise("crossing")
    return per.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("groups"))


@query(
    "group_membership_filter",
    """SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def group_membership_filter(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("l_orderkey")
    )
    kept = table(spark, sf, "lineitem").join(urgent, "l_orderkey", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


# --- frontier, matching, report order ---------------------------------------------------------------

CANDIDATES_SQL = f"""WITH {LINE_SQL}, X AS (SELECT cluster_id AS candidate, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS accuracy,
  abs(avg(y_pred) - avg(y_true)) AS fairness_gap FROM L GROUP BY cluster_id)"""


def candidates(spark, sf):
    """Every customer as a candidate model."""
    return line_frame(spark, sf).groupBy(F.col("cluster_id").alias("candidate")).agg(
        F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1).otherwise(0)).alias("accuracy"),
        F.abs(F.avg("y_pred") - F.avg("y_true")).alias("fairness_gap"),
    )


@query(
    "pareto_frontier",
    f"""{CANDIDATES_SQL} SELECT * FROM X a WHERE NOT EXISTS (SELECT 1 FROM X b WHERE b.accuracy >= a.accuracy
  AND b.fairness_gap <= a.fairness_gap AND (b.accuracy > a.accuracy OR b.fairness_gap < a.fairness_gap))""",
)
def pareto_frontier(spark, sf):
    return K.pareto_frontier(candidates(spark, sf))


@query(
    "best_candidate",
    f"""{CANDIDATES_SQL} SELECT candidate, accuracy, fairness_gap,
  accuracy - 0.25::DOUBLE * fairness_gap AS utility FROM X ORDER BY utility DESC, accuracy DESC, candidate LIMIT 1""",
)
def best_candidate(spark, sf):
    scored = candidates(spark, sf).withColumn("utility", M.utility_score("accuracy", "fairness_gap"))
    return scored.orderBy(F.desc("utility"), F.desc("accuracy"), "candidate").limit(1)


@query(
    "nearest_match",
    """WITH C AS (SELECT value AS s, min(event_id) AS id FROM events WHERE event_type <> 'purchase' GROUP BY value),
T AS (SELECT DISTINCT value AS s FROM events WHERE event_type = 'purchase')
SELECT T.s AS score, x.s AS control_score, x.id AS control_id FROM T,
LATERAL (SELECT C.s, C.id FROM C ORDER BY abs(C.s - T.s), C.s LIMIT 1) x""",
)
def nearest_match(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), F.col("value").alias("score"),
        (F.col("event_type") == "purchase").cast("int").alias("treated"),
    )
    return K.nearest_controls(e)


@query(
    "worst_groups",
    f"""WITH {DOC_SQL}, DX AS (SELECT * REPLACE (source AS grp) FROM D), {cells_sql("DX")}, {rates_sql()}
SELECT grp, (tpr + tnr) / 2.0 AS balanced_accuracy, tpr, n AS sample_size FROM R
WHERE n >= 8 AND tp + fn >= 3 AND tn + fp >= 3 ORDER BY balanced_accuracy NULLS LAST, grp LIMIT 3""",
)
def worst_groups(spark, sf):
    cells = confusion_cells(document_frame(spark, sf).withColumn("grp", F.col("source")))
    return K.worst_groups(M.subgroup_table(cells, M.Gates(8, 3, 3)))


@query(
    "worst_group_disclosure",
    f"""{SPARSE_SQL}, Y AS (SELECT n >= 20 AND tp + fn >= 5 AND tn + fp >= 5 AS ok FROM R)
SELECT count(*) AS groups_searched, count(*) FILTER (WHERE ok) AS supported_groups,
  count(*) FILTER (WHERE NOT ok) AS unsupported_groups, 5 AS metrics_searched, 8 * count(*) AS comparisons FROM Y""",
)
def worst_group_disclosure(spark, sf):
    cells = confusion_cells(with_intersection(document_frame(spark, sf), INTERSECTION))
    return K.worst_group_disclosure(M.subgroup_table(cells, M.Gates(20, 5, 5)))


@query(
    "redacted_report",
    f"""{SPARSE_SQL}, Y AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS r FROM R WHERE n >= 10)
SELECT 'REDACTED_GROUP_' || lpad(CAST(r AS VARCHAR), 3, '0') AS grp, n, selection_rate, tpr, fpr FROM Y WHERE r <= 8""",
)
def redacted_report(spark, sf):
    cells = confusion_cells(with_intersection(document_frame(spark, sf), INTERSECTION))
    out = K.redacted_subgroups(M.subgroup_table(cells), 10, max_groups=8, mask_labels=True)
    return out.select("grp", "n", "selection_rate", "tpr", "fpr")
