"""Registration of named queries and the shared audit frames over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, an independent SQL form."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- audit frames --------------------------------------------------------------------------

def line_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: returned or not, scored by discount, grouped by market segment."""
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    score = F.col("l_discount") * 10
    return joined.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.when(score >= 0.5, 1).otherwise(0).alias("y_pred"),
        score.alias("y_prob"),
        F.col("c_mktsegment").alias("grp"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_orderkey").alias("entity_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.col("l_quantity").alias("weight"),
        F.col("l_shipdate").alias("ts"),
    )


LINE_SQL = """
L AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         l_discount * 10 AS y_prob, c_mktsegment AS grp, o_orderpriority AS priority,
         l_orderkey AS entity_id, o_custkey AS cluster_id, l_quantity AS weight, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""


def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: purchase or not, scored by value, grouped by quarter of the day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y_true"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("y_pred"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("y_prob"),
        F.concat(F.lit("q"), (F.hour("ts") / 6).cast("int").cast("string")).alias("grp"),
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("entity_id"),
        F.col("user_id").alias("cluster_id"),
        "ts",
        "value",
        "event_type",
        "props",
    )


EVENT_SQL = """
E AS (
  SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true,
         CASE WHEN value > 50 THEN 1 ELSE 0 END AS y_pred,
         least(value / 200.0, 1.0) AS y_prob,
         concat('q', CAST(hour(ts) // 6 AS VARCHAR)) AS grp,
         event_id AS row_id, user_id AS entity_id, user_id AS cluster_id, ts, value, event_type, props
  FROM events
)"""


def document_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality label, decided by length, grouped by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").join(d, "doc_id")
    return joined.select(
        F.col("quality").alias("y_true"),
        F.when(F.col("n_chars").between(200, 4000), 1).otherwise(0).alias("y_pred"),
        F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("y_prob"),
        F.col("lang").alias("grp"),
        "lang",
        "source",
        F.col("doc_id").alias("row_id"),
        "toxic",
    )


DOC_SQL = """
D AS (
  SELECT quality AS y_true, CASE WHEN n_chars BETWEEN 200 AND 4000 THEN 1 ELSE 0 END AS y_pred,
         least(n_chars / 4000.0, 1.0) AS y_prob, lang AS grp, lang, source, labels.doc_id AS row_id, toxic
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id
)"""


def order_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: filled or not, scored by price, grouped by market segment."""
    o = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    score = F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0))
    return o.select(
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y_true"),
        F.when(score >= 0.5, 1).otherwise(0).alias("y_pred"),
        score.alias("y_prob"),
        F.col("c_mktsegment").alias("grp"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderdate").alias("ts"),
        "o_totalprice",
        "c_acctbal",
        F.col("c_nationkey").cast("double").alias("nation"),
        "o_orderpriority",
    )


ORDER_SQL = """
O AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true,
         CASE WHEN least(o_totalprice / 500000.0, 1.0) >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         least(o_totalprice / 500000.0, 1.0) AS y_prob, c_mktsegment AS grp, o_orderkey AS row_id,
         o_custkey AS cluster_id, o_orderdate AS ts, o_totalprice, c_acctbal,
         CAST(c_nationkey AS DOUBLE) AS nation, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

CELLS = """
  count(*) AS n,
  CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos_n,
  CAST(sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg_n,
  CAST(sum(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS sel_n,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"""


def cells_sql(frame: str, name: str = "C", by: str = "grp") -> str:
    """Confusion cells per group as a CTE."""
    return f"{name} AS (SELECT {by}, {CELLS} FROM {frame} GROUP BY {by})"


#: Rates of a cells CTE.
RATES = """
  tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, fp / nullif(tn + fp, 0) AS fpr,
  fn / nullif(tp + fn, 0) AS fnr, tp / nullif(tp + fp, 0) AS ppv,
  (tp + fp) / nullif(tp + fp + fn + tn, 0) AS selection_rate,
  (tp + fn) / nullif(tp + fp + fn + tn, 0) AS positive_prevalence"""


def rates_sql(cells: str = "C", name: str = "R") -> str:
    return f"{name} AS (SELECT *, {RATES} FROM {cells})"


def disparity_sql(
    rates: str = "R",
    name: str = "W",
    by: str = "",
    size: int = 5,
    positives: int = 0,
    negatives: int = 0,
    di_size: int | None = None,
) -> str:
    """All gated disparities as one wide CTE, written from the definitions."""
    di_size = size if di_size is None else di_size
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    eo_pos = f"WHEN pos_n < {positives} THEN 'INSUFFICIENT_GROUP_SUPPORT'" if positives else ""
    odds_pos = f"WHEN tp + fn < {positives} THEN 'INSUFFICIENT_GROUP_SUPPORT'" if positives else ""
    odds_neg = f"WHEN tn + fp < {negatives} THEN 'INSUFFICIENT_GROUP_SUPPORT'" if negatives else ""
    gate = "WHEN groups < 2 THEN 'MISSING_SENSITIVE' WHEN min_n < {} THEN 'INSUFFICIENT_GROUP_SUPPORT'"
    return f"""
{name}_f AS (
  SELECT *,
    CASE WHEN pos_n = 0 THEN 'ZERO_POSITIVE_SUBGROUP' {eo_pos} END AS eo_fail,
    CASE WHEN tp + fn = 0 THEN 'ZERO_POSITIVE_SUBGROUP' WHEN tn + fp = 0 THEN 'ZERO_NEGATIVE_SUBGROUP'
         {odds_pos} {odds_neg} END AS odds_fail,
    CASE WHEN sel_n = 0 THEN 'UNDEFINED' END AS pp_fail
  FROM {rates}),
{name}_g AS (
  SELECT {lead} count(*) AS groups, min(n) AS min_n,
    max(selection_rate) - min(selection_rate) AS dp, max(tpr) - min(tpr) AS eo,
    greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS odds, max(ppv) - min(ppv) AS pp,
    min(selection_rate) AS lo, max(selection_rate) AS hi,
    arg_min(eo_fail, grp) FILTER (WHERE eo_fail IS NOT NULL) AS eo_fail,
    arg_min(odds_fail, grp) FILTER (WHERE odds_fail IS NOT NULL) AS odds_fail,
    arg_min(pp_fail, grp) FILTER (WHERE pp_fail IS NOT NULL) AS pp_fail
  FROM {name}_f {group}),
{name}_s AS (
  SELECT *,
    CASE {gate.format(size)} ELSE 'VALID' END AS dp_status,
    coalesce(CASE {gate.format(size)} END, eo_fail, 'VALID') AS eo_status,
    coalesce(CASE {gate.format(size)} END, odds_fail, 'VALID') AS eodds_status,
    coalesce(CASE WHEN groups < 2 THEN 'MISSING_SENSITIVE' END, pp_fail, 'VALID') AS pp_status,
    CASE {gate.format(di_size)} WHEN hi <= 0 THEN 'UNDEFINED'
         WHEN hi < 0.0001 OR lo < 0.0001 THEN 'UNSTABLE_RATIO' ELSE 'VALID' END AS di_status
  FROM {name}_g),
{name} AS (
  SELECT *, CASE WHEN dp_status = 'VALID' THEN dp END AS dp_value,
    CASE WHEN eo_status = 'VALID' THEN eo END AS eo_value,
    CASE WHEN eodds_status = 'VALID' THEN odds END AS eodds_value,
    CASE WHEN pp_status = 'VALID' THEN pp END AS pp_value,
    CASE WHEN di_status = 'VALID' THEN lo / hi END AS di_value
  FROM {name}_s)"""


#: Totals of a cells CTE (one row).
TOTAL = """
  CAST(sum(n) AS BIGINT) AS n, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp"""

#: Mean of the defined terms of W.
GAP4 = """
  (coalesce(dp_value, 0) + coalesce(eo_value, 0) + coalesce(eodds_value, 0) + coalesce(pp_value, 0))
  / nullif((dp_value IS NOT NULL)::INT + (eo_value IS NOT NULL)::INT + (eodds_value IS NOT NULL)::INT
           + (pp_value IS NOT NULL)::INT, 0)"""
