"""Decision units, intersections, missing groups, reweighing, derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.registry import (
    CELLS, DOC_SQL, EVENT_SQL, LINE_SQL, ORDER_SQL, cells_sql, disparity_sql, document_frame, event_frame,
    line_frame, order_frame, query, rates_sql, table,
)
from evenhand.operators import frames as R
from evenhand.operators import metrics as M
from evenhand.operators import units as U
from evenhand.operators.cells import confusion_cells

# --- entity profile and collapse -------------------------------------------------------------


@query(
    "entity_profile",
    f"""WITH {LINE_SQL}, P AS (SELECT entity_id, count(*) AS r FROM L GROUP BY entity_id)
SELECT CAST(sum(r) AS BIGINT) AS n_records, count(*) AS unit_cardinality, CAST(0 AS BIGINT) AS null_count,
  min(r) AS min_rows, avg(r) AS mean_rows, max(r) AS max_rows, (sum(r) - count(*)) / sum(r) AS duplicate_key_rate,
  (SELECT count(DISTINCT cluster_id) FROM L) AS cluster_cardinality FROM P""",
)
def entity_profile(spark, sf):
    return U.entity_profile(line_frame(spark, sf), "entity_id", "cluster_id")


def _collapse_sql(target: str, pred: str) -> str:
    pick = {
        "ANY_FAILURE": "CASE WHEN count(*) FILTER (WHERE {c} = 0) = 0 THEN 1 ELSE 0 END",
        "ALL_SUCCESS": "CASE WHEN count(*) FILTER (WHERE {c} = 1) > 0 THEN 1 ELSE 0 END",
        "MAJORITY_VOTE": "CASE WHEN 2 * count(*) FILTER (WHERE {c} = 1) > count(*) THEN 1 ELSE 0 END",
        "FIRST_RECORD": "first({c} ORDER BY row_id)",
        "LAST_RECORD": "last({c} ORDER BY row_id)",
    }
    return f"""WITH {EVENT_SQL} SELECT entity_id, {pick[target].format(c="y_true")} AS y_true,
  {pick[pred].format(c="y_pred")} AS y_pred, first(grp ORDER BY row_id) AS grp, count(*) AS records,
  round(avg(y_prob), 8) AS y_prob, first(cluster_id ORDER BY row_id) AS cluster_id,
  CASE WHEN count(DISTINCT grp) = 1 THEN 1 ELSE 2 END AS mixed_groups FROM E GROUP BY entity_id"""


def _register_collapse(name, target, pred):
    @query(name, _collapse_sql(target, pred))
    def run(spark, sf):
        out = U.collapse_entities(event_frame(spark, sf), target_strategy=target, prediction_strategy=pred)
        return out.withColumn("y_prob", F.round("y_prob", 8))


_register_collapse("entity_any_failure", "ANY_FAILURE", "ANY_FAILURE")
_register_collapse("entity_all_success", "ALL_SUCCESS", "ALL_SUCCESS")
_register_collapse("entity_majority", "MAJORITY_VOTE", "MAJORITY_VOTE")
_register_collapse("entity_first_last", "FIRST_RECORD", "LAST_RECORD")
_register_collapse("entity_mixed_strategies", "ANY_FAILURE", "ALL_SUCCESS")


@query(
    "entity_level_rates",
    f"""WITH {LINE_SQL}, X AS (SELECT entity_id, max(y_true) AS y_true, min(y_pred) AS y_pred, min(grp) AS grp
  FROM L GROUP BY entity_id), {cells_sql("X")}, {rates_sql()}
SELECT grp, n, selection_rate, tpr, fpr FROM R""",
)
def entity_level_rates(spark, sf):
    """Rates of orders instead of lines: an order belongs to one customer, hence to one group."""
    one = U.collapse_entities(
        line_frame(spark, sf), order=("ts",), target_strategy="ALL_SUCCESS", prediction_strategy="ANY_FAILURE"
    )
    return M.with_rates(confusion_cells(one)).select("grp", "n", "selection_rate", "tpr", "fpr")


ENTITY_WEIGHT = f"""WITH {EVENT_SQL}, S AS (SELECT entity_id, count(*) AS k FROM E GROUP BY entity_id),
N AS (SELECT count(*) AS n, count(DISTINCT entity_id) AS u FROM E),
X AS (SELECT E.*, (1.0 / k) * (n / u) AS w FROM E JOIN S USING (entity_id), N)"""


@query("entity_weights", f"{ENTITY_WEIGHT} SELECT row_id, entity_id, round(w, 9) AS entity_weight FROM X")
def entity_weights(spark, sf):
    out = U.entity_weights(event_frame(spark, sf))
    return out.select("row_id", "entity_id", F.round("entity_weight", 9).alias("entity_weight"))


@query(
    "entity_weighted_rates",
    f"""{ENTITY_WEIGHT}
SELECT grp, count(*) AS n, round(sum(w * y_pred) / sum(w), 8) AS selection_rate,
  round(sum(w * y_pred * y_true) / sum(w * y_true), 8) AS tpr,
  round(sum(w * y_pred * (1 - y_true)) / sum(w * (1 - y_true)), 8) AS fpr, round(sum(w), 6) AS total_weight
FROM X GROUP BY grp""",
)
def entity_weighted_rates(spark, sf):
    r = M.with_rates(U.entity_weighted_cells(event_frame(spark, sf)))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return r.select(
        "grp", "n", *[F.round(c, 8).alias(c) for c in ("selection_rate", "tpr", "fpr")],
        F.round(total, 6).alias("total_weight"),
    )


@query(
    "unit_guard",
    f"""WITH {EVENT_SQL}, P AS (SELECT entity_id, count(*) AS r FROM E GROUP BY entity_id)
SELECT max(r) > 1 AS repeated, count(*) FILTER (WHERE r > 1) AS repeated_entities FROM P""",
)
def unit_guard(spark, sf):
    per = event_frame(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("r"))
    return per.agg((F.max("r") > 1).alias("repeated"), F.count(F.when(F.col("r") > 1, 1)).alias("repeated_entities"))


# --- intersections ----------------------------------------------------------------------------

SEGMENT_PRIORITY = U.IntersectionSpec(["grp", "priority"])


@query(
    "intersection_rates",
    f"""WITH {LINE_SQL}, X AS (SELECT * REPLACE (concat(grp, ' x ', priority) AS grp) FROM L), {cells_sql("X")},
{rates_sql()} SELECT grp, n, selection_rate, tpr, fpr, ppv FROM R""",
)
def intersection_rates(spark, sf):
    cells = confusion_cells(U.with_intersection(line_frame(spark, sf), SEGMENT_PRIORITY))
    return M.with_rates(cells).select("grp", "n", "selection_rate", "tpr", "fpr", "ppv")


@query(
    "intersection_grouping_sets",
    f"""WITH {LINE_SQL}, X AS (SELECT 'grp' AS grouping, grp, y_true, y_pred FROM L
  UNION ALL SELECT 'priority', priority, y_true, y_pred FROM L
  UNION ALL SELECT 'grp x priority', concat(grp, ' x ', priority), y_true, y_pred FROM L)
SELECT grouping, grp, {CELLS} FROM X GROUP BY grouping, grp""",
)
def intersection_grouping_sets(spark, sf):
    specs = [U.IntersectionSpec(["grp"]), U.IntersectionSpec(["priority"]), SEGMENT_PRIORITY]
    return U.grouping_set_cells(line_frame(spark, sf), specs)


@query(
    "intersection_provenance",
    f"""WITH {DOC_SQL} SELECT DISTINCT concat(lang, ' x ', source) AS grp, lang, source FROM D""",
)
def intersection_provenance(spark, sf):
    out = U.intersection_provenance(document_frame(spark, sf), U.IntersectionSpec(["lang", "source"]))
    return out.select("grp", F.col("attributes")["lang"].alias("lang"), F.col("attributes")["source"].alias("source"))


@query(
    "intersection_disparities",
    f"""WITH {LINE_SQL}, X AS (SELECT * REPLACE (concat(grp, ' x ', priority) AS grp) FROM L), {cells_sql("X")},
{rates_sql()}, {disparity_sql(size=20, positives=5, negatives=5)}
SELECT groups, dp_value, dp_status, eodds_value, eodds_status, di_value, di_status FROM W""",
)
def intersection_disparities(spark, sf):
    cells = confusion_cells(U.with_intersection(line_frame(spark, sf), SEGMENT_PRIORITY))
    return M.disparity_wide(cells, M.Gates(20, 5, 5)).select(
        "groups", "dp_value", "dp_status", "eodds_value", "eodds_status", "di_value", "di_status"
    )


# --- missing groups ------------------------------------------------------------------------------

GAPS_SQL = f"""{EVENT_SQL}, H AS (SELECT * REPLACE (CASE event_type WHEN 'error' THEN ' unknown ' WHEN 'view' THEN NULL
  WHEN 'signup' THEN 'Other' ELSE grp END AS grp) FROM E)"""
MISSING = "coalesce(upper(trim(grp)), '') IN ('', 'UNKNOWN', 'NULL', 'NONE', 'OTHER', 'MALFORMED', 'MISSING', 'NAN')"


def gap_frame(spark, sf):
    """Event frame in which some event types carry no usable group."""
    grp = (
        F.when(F.col("event_type") == "error", " unknown ")
        .when(F.col("event_type") == "view", None)
        .when(F.col("event_type") == "signup", "Other")
        .otherwise(F.col("grp"))
    )
    return event_frame(spark, sf).withColumn("grp", grp)


@query(
    "missing_group_policy",
    f"""WITH {GAPS_SQL}, X AS (
  SELECT 'REJECT' AS policy, coalesce(grp, 'UNKNOWN') AS grp, y_true, y_pred FROM H UNION ALL
  SELECT 'EXCLUDE', grp, y_true, y_pred FROM H WHERE NOT ({MISSING}) UNION ALL
  SELECT 'EXPLICIT_UNKNOWN_GROUP', CASE WHEN {MISSING} THEN 'UNKNOWN' ELSE grp END, y_true, y_pred FROM H UNION ALL
  SELECT 'IMPUTE_WITH_DOCUMENTED_RULE', coalesce(grp, 'DERIVED_PROXY_IMPUTED'), y_true, y_pred FROM H)
SELECT policy, grp, {CELLS} FROM X GROUP BY policy, grp""",
)
def missing_group_policy(spark, sf):
    out = None
    for policy in ("REJECT", "EXCLUDE", "EXPLICIT_UNKNOWN_GROUP", "IMPUTE_WITH_DOCUMENTED_RULE"):
        part = confusion_cells(R.apply_missing_policy(gap_frame(spark, sf), policy)).select(
            F.lit(policy).alias("policy"), "*"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "missing_group_summary",
    f"""WITH {GAPS_SQL}, T AS (SELECT count(*) AS n, CAST(sum(CASE WHEN {MISSING} THEN 1 ELSE 0 END) AS BIGINT) AS m FROM H)
SELECT 'REJECT' AS policy, m AS missing_count, m / n AS missing_fraction, 'REJECTED_EVALUATION' AS action_taken,
  'MISSING_ATTRIBUTE_VIOLATION' AS initial_status, CAST(0 AS BIGINT) AS excluded_count FROM T UNION ALL
SELECT 'EXCLUDE', m, m / n, 'EXCLUDED_FROM_METRICS', 'VALID', m FROM T""",
)
def missing_group_summary(spark, sf):
    frame = gap_frame(spark, sf)
    return R.missing_group_summary(frame, "REJECT").unionByName(R.missing_group_summary(frame, "EXCLUDE"))


@query(
    "imputation_record",
    f"""WITH {GAPS_SQL}, T AS (SELECT count(*) AS m FROM H WHERE {MISSING})
SELECT 'R-7' AS rule_id, 'quarter of the day by event type' AS rule_description, m AS original_missing_count, m AS imputed_count,
  CAST(0 AS BIGINT) AS remaining_missing_count, 'DERIVED_PROXY' AS sensitive_origin, '{R.IMPUTATION_NOTE}' AS disclaimer FROM T""",
)
def imputation_record(spark, sf):
    return R.imputation_record(gap_frame(spark, sf), rule_id="R-7", rule="quarter of the day by event type")


@query(
    "input_guards",
    f"""WITH {DOC_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS y_true_not_finite, CAST(0 AS BIGINT) AS y_pred_not_finite,
  count(*) FILTER (WHERE n_chars NOT IN (0, 1)) AS y_pred_not_binary,
  count(*) FILTER (WHERE y_true NOT IN (0, 1)) AS y_true_not_binary
FROM (SELECT D.*, n_chars FROM D JOIN documents ON row_id = doc_id)""",
)
def input_guards(spark, sf):
    """A length column handed in as the prediction is caught as not binary."""
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("y_pred"))
    frame = table(spark, sf, "labels").join(d, "doc_id").withColumnRenamed("quality", "y_true")
    return R.input_problems(frame)


# --- derived columns, reweighing, priors -------------------------------------------------------------

@query(
    "top5_other",
    """WITH T AS (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5)
SELECT CASE WHEN T.source IS NULL THEN 'Other' ELSE d.source END AS source, count(*) AS n
FROM documents d LEFT JOIN T ON d.source = T.source GROUP BY 1""",
)
def top5_other(spark, sf):
    d = table(spark, sf, "documents").select("source")
    return R.top_values(d, "source", 5).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


REWEIGH = f"""WITH {LINE_SQL}, J AS (SELECT grp, y_true, count(*) AS n FROM L GROUP BY grp, y_true),
X AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS ng, sum(n) OVER (PARTITION BY y_true) AS ny, sum(n) OVER () AS t FROM J),
Y AS (SELECT grp, y_true, n, greatest((ng / t) * (ny / t) / greatest(n / t, 1e-9), 1e-3) AS raw FROM X)"""


@query(
    "reweighing_weights",
    f"""{REWEIGH} SELECT grp, y_true, n, round(raw / (SELECT sum(raw * n) / sum(n) FROM Y), 9) AS weight FROM Y""",
)
def reweighing_weights(spark, sf):
    return U.reweighing_table(line_frame(spark, sf)).withColumn("weight", F.round("weight", 9))


@query(
    "reweighed_rows",
    f"""WITH {ORDER_SQL}, J AS (SELECT grp, y_true, count(*) AS n FROM O GROUP BY grp, y_true),
X AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS ng, sum(n) OVER (PARTITION BY y_true) AS ny, sum(n) OVER () AS t FROM J),
Y AS (SELECT grp, y_true, n, greatest((ng / t) * (ny / t) / greatest(n / t, 1e-9), 1e-3) AS raw FROM X)
SELECT O.row_id, O.grp, round(raw / (SELECT sum(raw * n) / sum(n) FROM Y), 9) AS weight
FROM O JOIN Y ON O.grp = Y.grp AND O.y_true = Y.y_true""",
)
def reweighed_rows(spark, sf):
    out = U.with_reweighing(order_frame(spark, sf))
    return out.select("row_id", "grp", F.round("weight", 9).alias("weight"))


PRIORITY_MAP = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid", "5-LOW": "low"}


@query(
    "label_prior",
    """WITH M AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
  WHEN '3-MEDIUM' THEN 'mid' WHEN '5-LOW' THEN 'low' END AS level FROM orders)
SELECT level, count(*) / (SELECT count(*) FROM M WHERE level IS NOT NULL) AS prior FROM M
WHERE level IS NOT NULL GROUP BY level""",
)
def label_prior(spark, sf):
    return U.label_prior(table(spark, sf, "orders"), "o_orderpriority", PRIORITY_MAP, ["high", "mid", "low"])


@query(
    "derived_features",
    """SELECT o_orderkey, CASE WHEN lower(trim(o_orderstatus)) IN ('true', '1', 'yes') THEN 0 ELSE 1 END AS kept,
  CASE WHEN lower(o_orderstatus) = 'f' THEN 1 ELSE 0 END AS filled,
  CASE WHEN o_custkey >= 700 THEN 'upper' ELSE 'lower' END AS tier,
  o_totalprice / (o_custkey + 0.000001::DOUBLE) AS price_per_key,
  abs(o_totalprice - 250000) AS deviation, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_hour
FROM orders""",
)
def derived_features(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        R.negated_flag("o_orderstatus").alias("kept"),
        (F.lower("o_orderstatus") == "f").cast("int").alias("filled"),
        F.when(F.col("o_custkey") >= 700, "upper").otherwise("lower").alias("tier"),
        R.guarded_ratio("o_totalprice", "o_custkey").alias("price_per_key"),
        F.abs(F.col("o_totalprice") - 250000).alias("deviation"),
        R.clock_hour("concat(substr(o_orderpriority, 1, 1), ':00:00')").alias("priority_hour"),
    )


@query(
    "drop_incomplete",
    """SELECT count(*) AS n FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id
WHERE quality IS NOT NULL AND lang IS NOT NULL""",
)
def drop_incomplete(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    joined = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.na.drop(subset=["quality", "lang"]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_contract",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders""",
)
def feature_contract(spark, sf):
    """Only columns known before the outcome stay (status and key roles are out)."""
    contract = spark.createDataFrame(
        [
            ("o_orderkey", "PRE_DISPATCH_VALID"), ("o_totalprice", "PRE_DISPATCH_VALID"),
            ("o_orderpriority", "PRE_DISPATCH_VALID"), ("o_orderstatus", "POST_OUTCOME"),
            ("o_custkey", "REVIEW_REQUIRED"), ("o_orderdate", "DERIVED_FROM_OUTCOME"),
        ],
        "feature_name string, classification string",
    )
    orders = table(spark, sf, "orders")
    return orders.select(*R.contract_columns(contract, orders.columns))


@query(
    "median_impute",
    """WITH X AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM X)) AS v FROM X""",
)
def median_impute(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")
    )
    return R.impute_median(e, "v")


@query(
    "column_kinds",
    """SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END
  AS kind, (SELECT count(*) FROM orders) AS table_rows
FROM (DESCRIBE orders) t(column_name, data_type, a, b, c, d)""",
)
def column_kinds(spark, sf):
    orders = table(spark, sf, "orders")
    numeric = set(R.numeric_columns(orders))
    rows = [(c, "numeric" if c in numeric else "categorical") for c in orders.columns]
    n = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.createDataFrame(rows, "column_name string, kind string").withColumn("table_rows", n)
