"""Suite rows, policy decisions, gate, taxonomy, review, success class, report privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.metric_core import COLLAPSE, PERFORMANCE, bins_sql
from evenhand.catalog.registry import (
    CELLS, DOC_SQL, EVENT_SQL, GAP4, LINE_SQL, TOTAL, cells_sql, disparity_sql, document_frame, event_frame,
    line_frame, query, rates_sql,
)
from evenhand.catalog.units_groups import GAPS_SQL, MISSING, gap_frame
from evenhand.operators import metrics as M
from evenhand.operators.cells import confusion_cells
from evenhand.plans import policy as P
from evenhand.plans.evaluate import AuditConfig, evaluate, evaluate_long

GATES = M.Gates(2, 1, 1, ratio_size=2)
NO_AUC = dict(with_auc=False)


def source_suites(spark, sf):
    """Every document source as a run with languages as groups: small runs show all statuses."""
    frame = document_frame(spark, sf).withColumn("run", F.col("source"))
    return evaluate(frame, AuditConfig(by=("run",), gates=GATES, **NO_AUC))


def priority_suites(spark, sf):
    """Every order priority as a run with market segments as groups: large, valid runs."""
    frame = line_frame(spark, sf).withColumn("run", F.col("priority"))
    return evaluate(frame, AuditConfig(by=("run",), **NO_AUC))


def runs_sql(frame_sql: str, frame: str, run: str, gates: str) -> str:
    """Suite values per run as CTE ``S``."""
    return f"""WITH {frame_sql}, C AS (SELECT {run} AS run, grp, {CELLS} FROM {frame} GROUP BY {run}, grp), {rates_sql()},
{disparity_sql(by="run", **eval(f"dict({gates})"))},
T AS (SELECT run, {TOTAL} FROM C GROUP BY run), PF AS (SELECT run, n, tn, fp, fn, tp, {PERFORMANCE},
  tn / nullif(tn + fp, 0) AS specificity, {COLLAPSE} AS degeneracy_status FROM T),
S AS (SELECT PF.*, W.* EXCLUDE (run), {GAP4} AS fairness_gap,
  CASE WHEN dp_status <> 'VALID' OR eo_status <> 'VALID' OR eodds_status <> 'VALID' OR di_status <> 'VALID'
       THEN 'UNDEFINED' ELSE 'VALID' END AS overall_status FROM PF JOIN W ON PF.run = W.run)"""


SOURCES = runs_sql(DOC_SQL, "D", "source", "size=2, positives=1, negatives=1, di_size=2")
PRIORITIES = runs_sql(LINE_SQL, "L", "priority", "size=5")

SUITE = """run, n AS sample_size, groups, accuracy, balanced_accuracy, precision, recall, f1_score, specificity,
  dp_value, dp_status, eo_value, eo_status, eodds_value, eodds_status, pp_value, pp_status, di_value, di_status,
  fairness_gap, coalesce(balanced_accuracy - 0.25::DOUBLE * coalesce(fairness_gap, 0.5), 0.0) AS utility_score,
  overall_status, degeneracy_status, 8 * groups AS number_of_comparisons"""
SUITE_COLUMNS = [
    "run", "sample_size", "groups", "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "specificity",
    *[f"{s}_{k}" for s in ("dp", "eo", "eodds", "pp", "di") for k in ("value", "status")],
    "fairness_gap", "utility_score", "overall_status", "degeneracy_status", "number_of_comparisons",
]


@query("evaluation_suites", f"{SOURCES} SELECT {SUITE} FROM S")
def evaluation_suites(spark, sf):
    return source_suites(spark, sf).select(*SUITE_COLUMNS)


@query("evaluation_suites_large", f"{PRIORITIES} SELECT {SUITE} FROM S")
def evaluation_suites_large(spark, sf):
    return priority_suites(spark, sf).select(*SUITE_COLUMNS)


@query(
    "evaluation_calibrated",
    f"""WITH {EVENT_SQL}, {bins_sql("E")}, N AS (SELECT count(*) AS n, avg((y_prob - y_true) ** 2) AS brier FROM E),
K AS (SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2.0 AS r FROM E),
A AS (SELECT sum(r) FILTER (WHERE y_true = 1) AS rs, sum(y_true) AS p, sum(1 - y_true) AS q FROM K)
SELECT any_value(N.n) AS sample_size, round(any_value(brier), 7) AS brier_score,
  round(sum(abs(pos - s)) / any_value(N.n), 7) AS expected_calibration_error,
  round(any_value((rs - p * (p + 1) / 2.0) / (p * q)), 8) AS roc_auc FROM B, N, A""",
)
def evaluation_calibrated(spark, sf):
    s = evaluate(event_frame(spark, sf))
    return s.select(
        "sample_size",
        F.round("brier_score", 7).alias("brier_score"),
        F.round("expected_calibration_error", 7).alias("expected_calibration_error"),
        F.round("roc_auc", 8).alias("roc_auc"),
    )


@query(
    "evaluation_missing_groups",
    f"""WITH {GAPS_SQL}, X AS (SELECT coalesce(grp, 'UNKNOWN') AS grp, y_true, y_pred FROM H), {cells_sql("X")},
T AS (SELECT count(*) AS n, CAST(sum(CASE WHEN coalesce(upper(trim(grp)), '') IN
  ('', 'UNKNOWN', 'NULL', 'NONE', 'OTHER', 'MALFORMED', 'MISSING', 'NAN') THEN 1 ELSE 0 END) AS BIGINT) AS m FROM H)
SELECT any_value(T.n) AS sample_size, count(*) AS groups, any_value(m) AS missing_count,
  'MISSING_ATTRIBUTE_VIOLATION' AS overall_status, 'REJECTED_EVALUATION' AS action_taken FROM C, T""",
)
def evaluation_missing_groups(spark, sf):
    s = evaluate(gap_frame(spark, sf), AuditConfig(**NO_AUC))
    return s.select(
        "sample_size", "groups", F.col("missing_handling.missing_count").alias("missing_count"), "overall_status",
        F.col("missing_handling.action_taken").alias("action_taken"),
    )


@query(
    "evaluation_policies",
    f"""WITH {GAPS_SQL}, T AS (SELECT count(*) FILTER (WHERE {MISSING}) AS m FROM H), X AS (
  SELECT 'REJECT' AS policy, coalesce(grp, 'UNKNOWN') AS grp, y_true, y_pred FROM H UNION ALL
  SELECT 'EXCLUDE', grp, y_true, y_pred FROM H WHERE NOT ({MISSING}) UNION ALL
  SELECT 'EXPLICIT_UNKNOWN_GROUP', CASE WHEN {MISSING} THEN 'UNKNOWN' ELSE grp END, y_true, y_pred FROM H UNION ALL
  SELECT 'IMPUTE_WITH_DOCUMENTED_RULE', coalesce(grp, 'DERIVED_PROXY_IMPUTED'), y_true, y_pred FROM H),
C AS (SELECT policy, grp, {CELLS} FROM X GROUP BY policy, grp), {rates_sql()}, {disparity_sql(by="policy", size=5, positives=5, negatives=5)},
Z AS (SELECT policy, CAST(sum(n) AS BIGINT) AS sample_size FROM C GROUP BY policy)
SELECT W.policy, sample_size, groups, m AS missing_count, CASE W.policy WHEN 'REJECT' THEN 'REJECTED_EVALUATION' WHEN 'EXCLUDE' THEN 'EXCLUDED_FROM_METRICS'
  WHEN 'EXPLICIT_UNKNOWN_GROUP' THEN 'MAPPED_TO_EXPLICIT_UNKNOWN_GROUP' ELSE 'IMPUTED_WITH_DOCUMENTED_RULE' END AS action_taken,
  CASE WHEN W.policy = 'IMPUTE_WITH_DOCUMENTED_RULE' THEN m END AS imputed_count, dp_value, dp_status, eodds_value, eodds_status, di_value, di_status
FROM W JOIN Z ON W.policy = Z.policy, T""",
)
def evaluation_policies(spark, sf):
    """A whole audit under each of the four missing-group policies."""
    out = None
    for policy in ("REJECT", "EXCLUDE", "EXPLICIT_UNKNOWN_GROUP", "IMPUTE_WITH_DOCUMENTED_RULE"):
        s = evaluate(gap_frame(spark, sf), AuditConfig(missing_policy=policy, gates=M.Gates(5, 5, 5), **NO_AUC)).select(
            F.lit(policy).alias("policy"), "sample_size", "groups", F.col("missing_handling.missing_count").alias("missing_count"),
            F.col("missing_handling.action_taken").alias("action_taken"), F.col("imputation.imputed_count").alias("imputed_count"),
            "dp_value", "dp_status", "eodds_value", "eodds_status", "di_value", "di_status",
        )
        out = s if out is None else out.unionByName(s)
    return out


@query(
    "evaluation_entity_weighted",
    f"""WITH {EVENT_SQL}, X AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY entity_id) AS w FROM E),
G AS (SELECT grp, count(*) AS n, sum(w) AS t, sum(w * y_pred) / sum(w) AS s, sum(w * y_true * y_pred) / sum(w * y_true) AS r,
  sum(w * (1 - y_true) * y_pred) / sum(w * (1 - y_true)) AS f FROM X GROUP BY grp)
SELECT CAST(sum(n) AS BIGINT) AS sample_size, count(*) AS groups, round(max(s) - min(s), 8) AS dp_value, 'VALID' AS dp_status,
  round(greatest(max(r) - min(r), max(f) - min(f)), 8) AS eodds_value, 'VALID' AS eodds_status FROM G""",
)
def evaluation_entity_weighted(spark, sf):
    """A whole audit in which every entity weighs the same, however many records it has."""
    config = AuditConfig(unit_level="ENTITY_LEVEL", unit_key="entity_id", strategy="ENTITY_WEIGHTED", **NO_AUC)
    s = evaluate(event_frame(spark, sf).withColumn("run", F.lit("all")), config)
    return s.select("sample_size", "groups", F.round("dp_value", 8).alias("dp_value"), "dp_status", F.round("eodds_value", 8).alias("eodds_value"), "eodds_status")


@query(
    "evaluation_entity_units",
    f"""WITH {EVENT_SQL}, X AS (SELECT entity_id, min(y_true) AS y_true, max(y_pred) AS y_pred,
  first(grp ORDER BY row_id) AS grp FROM E GROUP BY entity_id), {cells_sql("X")}, {rates_sql()}, {disparity_sql(size=1)}
SELECT min_n, dp_value, dp_status, eodds_status, pp_status FROM W""",
)
def evaluation_entity_units(spark, sf):
    config = AuditConfig(
        gates=M.Gates(1), unit_level="ENTITY_LEVEL", unit_key="entity_id", target_strategy="ANY_FAILURE",
        prediction_strategy="ALL_SUCCESS", **NO_AUC,
    )
    frame = event_frame(spark, sf).withColumn("run", F.lit("all"))
    s = evaluate(frame, config)
    return s.select(
        F.array_min(F.transform("subgroups", lambda g: g["n"])).alias("min_n"), "dp_value", "dp_status",
        "eodds_status", "pp_status",
    )


# --- decisions -----------------------------------------------------------------------------------------

POLICY_ROWS = """PO AS (SELECT * FROM (VALUES
  ('Standard_Operational_Policy', 0.55::DOUBLE, 0.10::DOUBLE, 0.80::DOUBLE, 0.10::DOUBLE),
  ('Strict_Equalized_Odds_Policy', 0.60::DOUBLE, 0.05::DOUBLE, 0.85::DOUBLE, 0.50::DOUBLE),
  ('Lenient_Diagnostic_Policy', 0.52::DOUBLE, 0.15::DOUBLE, 0.70::DOUBLE, 0.10::DOUBLE))
  p(policy_name, min_bal, max_odds, min_di, min_recall))"""
DECIDED = """X AS (SELECT S.*, PO.*, degeneracy_status <> 'NORMAL' AS deg,
  (overall_status <> 'VALID')::INT + (di_status = 'UNSTABLE_RATIO')::INT AS abstention_count,
  coalesce((balanced_accuracy < min_bal)::INT, 0) + coalesce((recall < min_recall)::INT, 0)
    + coalesce((specificity < 0.10)::INT, 0) + (degeneracy_status <> 'NORMAL')::INT AS utility_fails,
  coalesce((eodds_status <> 'VALID' OR eodds_value > max_odds)::INT, 0)
    + coalesce((dp_status <> 'VALID' OR dp_value > 0.10)::INT, 0)
    + CASE WHEN di_status = 'VALID' THEN (di_value < min_di)::INT WHEN di_status = 'UNSTABLE_RATIO' THEN 1 ELSE 0 END
    AS fairness_fails FROM S, PO),
Y AS (SELECT *, utility_fails + fairness_fails AS violation_count, fairness_fails = 0 AS is_fair,
  NOT deg AND coalesce(balanced_accuracy >= min_bal, false) AS is_useful,
  CASE WHEN deg THEN 'POLICY_DEGENERATE' WHEN abstention_count > 0 THEN 'POLICY_UNDEFINED'
       WHEN utility_fails + fairness_fails > 0 THEN 'POLICY_NONCOMPLIANT' ELSE 'POLICY_COMPLIANT' END AS decision FROM X)"""
SHOW = """run, policy_name, decision, violation_count, abstention_count, is_fair, is_useful,
  CASE decision WHEN 'POLICY_COMPLIANT' THEN 'PASS' WHEN 'POLICY_UNDEFINED' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'FAIL' END
  AS evidence_state"""


def _decision_columns(decided):
    return decided.select(
        "run", F.col("policy.name").alias("policy_name"), "decision", "violation_count", "abstention_count", "is_fair",
        "is_useful", "evidence_state",
    )


@query("policy_decisions", f"{SOURCES}, {POLICY_ROWS}, {DECIDED} SELECT {SHOW} FROM Y")
def policy_decisions(spark, sf):
    return _decision_columns(P.decide(source_suites(spark, sf)))


@query("policy_sensitivity", f"{PRIORITIES}, {POLICY_ROWS}, {DECIDED} SELECT {SHOW} FROM Y")
def policy_sensitivity(spark, sf):
    return _decision_columns(P.decide(priority_suites(spark, sf)))


@query(
    "policy_trace",
    f"""{SOURCES} SELECT run, 'Equalized Odds Diff' AS metric, eodds_value AS observed,
  CASE WHEN eodds_status <> 'VALID' THEN 'INSUFFICIENT_EVIDENCE' WHEN eodds_value > 0.1 THEN 'FAILED' ELSE 'PASSED' END
    AS condition_status,
  CASE WHEN eodds_status <> 'VALID' THEN 'EO_DIFF_UNDEFINED' WHEN eodds_value > 0.1 THEN 'EO_DIFF_THRESHOLD_EXCEEDED'
       ELSE 'EO_DIFF_SATISFIED' END AS reason_code FROM S UNION ALL
SELECT run, 'Demographic Parity Diff', dp_value,
  CASE WHEN dp_status <> 'VALID' THEN 'INSUFFICIENT_EVIDENCE' WHEN dp_value > 0.1 THEN 'FAILED' ELSE 'PASSED' END,
  CASE WHEN dp_status <> 'VALID' THEN 'DP_DIFF_UNDEFINED' WHEN dp_value > 0.1 THEN 'DP_DIFF_THRESHOLD_EXCEEDED'
       ELSE 'DP_DIFF_SATISFIED' END FROM S UNION ALL
SELECT run, 'Disparate Impact Ratio', di_value,
  CASE WHEN di_status = 'VALID' AND di_value >= 0.8 THEN 'PASSED' ELSE 'FAILED' END,
  CASE WHEN di_status = 'UNSTABLE_RATIO' THEN 'DIR_UNSTABLE_RATIO' WHEN di_value < 0.8 THEN 'DIR_THRESHOLD_VIOLATION'
       ELSE 'DIR_SATISFIED' END FROM S WHERE di_status IN ('VALID', 'UNSTABLE_RATIO') UNION ALL
SELECT run, 'Balanced Accuracy', balanced_accuracy, CASE WHEN balanced_accuracy < 0.6 THEN 'FAILED' ELSE 'PASSED' END,
  CASE WHEN balanced_accuracy < 0.6 THEN 'BALANCED_ACCURACY_BELOW_MINIMUM' ELSE 'BALANCED_ACCURACY_SATISFIED' END FROM S""",
)
def policy_trace(spark, sf):
    rows = P.trace_rows(P.decide(source_suites(spark, sf), [P.Policy()]))
    return rows.filter(F.col("rule").isin("disparity") | (F.col("metric") == "Balanced Accuracy")).select(
        "run", "metric", "observed", "condition_status", "reason_code"
    )


@query(
    "policy_reason_codes",
    f"""{SOURCES}, Z AS (SELECT *, CASE WHEN degeneracy_status <> 'NORMAL' THEN 'POLICY_DEGENERATE'
  WHEN overall_status <> 'VALID' OR di_status = 'UNSTABLE_RATIO' THEN 'POLICY_UNDEFINED' ELSE 'other' END AS d FROM S)
SELECT run, concat_ws(',', CASE WHEN degeneracy_status <> 'NORMAL' THEN 'MODEL_DEGENERATE' END,
  CASE WHEN overall_status <> 'VALID' THEN 'STATUS_INSUFFICIENT_EVIDENCE' END,
  CASE WHEN di_status = 'UNSTABLE_RATIO' THEN 'UNSTABLE_RATIO_DENOMINATOR' END,
  CASE WHEN balanced_accuracy < 0.6 THEN 'BALANCED_ACCURACY_BELOW_MINIMUM' END,
  CASE WHEN recall < 0.1 THEN 'RECALL_BELOW_MINIMUM' END, CASE WHEN specificity < 0.1 THEN 'SPECIFICITY_BELOW_MINIMUM' END,
  CASE WHEN eodds_status <> 'VALID' THEN 'EO_DIFF_UNDEFINED' WHEN eodds_value > 0.1 THEN 'EO_DIFF_THRESHOLD_EXCEEDED' END,
  CASE WHEN dp_status <> 'VALID' THEN 'DP_DIFF_UNDEFINED' WHEN dp_value > 0.1 THEN 'DP_DIFF_THRESHOLD_EXCEEDED' END,
  CASE WHEN di_status = 'VALID' AND di_value < 0.8 THEN 'DIR_THRESHOLD_VIOLATION'
       WHEN di_status = 'UNSTABLE_RATIO' THEN 'DIR_UNSTABLE_RATIO' END) AS reason_codes
FROM Z WHERE d <> 'other'""",
)
def policy_reason_codes(spark, sf):
    decided = P.decide(source_suites(spark, sf), [P.Policy()])
    kept = decided.filter(F.col("decision").isin("POLICY_DEGENERATE", "POLICY_UNDEFINED"))
    return kept.select("run", F.concat_ws(",", "reason_codes").alias("reason_codes"))


FLOORS = P.Policy(
    "Floors", "POL-FLOOR-1", min_subgroup_balanced_accuracy=0.50, min_subgroup_recall=0.55,
    min_subgroup_specificity=0.50, require_subgroup_support=True, critical_subgroups=("AUTOMOBILE", "SPACE"),
    max_equalized_odds=0.02,
)


FLOORS_SQL = f"""WITH {LINE_SQL}, C AS (SELECT priority AS run, grp, {CELLS} FROM L GROUP BY priority, grp), {rates_sql()},
G AS (SELECT *, (tpr + tnr) / 2.0 AS bal, max(tpr) OVER (PARTITION BY run) AS best FROM R)
SELECT run, grp AS subgroup, 'SUBGROUP_BALANCED_ACCURACY_BELOW_MINIMUM' AS reason_code, bal AS observed FROM G WHERE bal < 0.5
UNION ALL SELECT run, grp, 'SUBGROUP_RECALL_BELOW_MINIMUM', tpr FROM G WHERE tpr < 0.55
UNION ALL SELECT run, grp, 'SUBGROUP_SPECIFICITY_BELOW_MINIMUM', tnr FROM G WHERE tnr < 0.5
UNION ALL SELECT run, grp, 'CRITICAL_SUBGROUP_DISPARITY_VIOLATION', best - tpr FROM G WHERE grp = 'AUTOMOBILE' AND best - tpr > 0.02
UNION ALL SELECT DISTINCT run, 'SPACE', 'CRITICAL_SUBGROUP_UNOBSERVED', NULL::DOUBLE FROM G"""


@query("policy_subgroup_floors", FLOORS_SQL)
def policy_subgroup_floors(spark, sf):
    rows = P.trace_rows(P.decide(priority_suites(spark, sf), [FLOORS]))
    return rows.filter(F.col("subgroup").isNotNull()).select("run", "subgroup", "reason_code", "observed")


@query("policy_floors_long", FLOORS_SQL)
def policy_floors_long(spark, sf):
    """The same evidence from groups as rows, for runs of any number of groups."""
    suites, groups = evaluate_long(line_frame(spark, sf).withColumn("run", F.col("priority")), AuditConfig(by=("run",), **NO_AUC))
    return P.decide_long(suites, groups, [FLOORS])[1].select("run", "subgroup", "reason_code", "observed")


@query(
    "required_subgroups",
    f"""WITH {DOC_SQL}, {cells_sql("D")}, Q(grp) AS (SELECT DISTINCT lang || CASE WHEN n_chars > 15000 THEN '-long' ELSE '' END
  FROM documents)
SELECT Q.grp, CASE WHEN C.grp IS NULL THEN 'CRITICAL_SUBGROUP_UNOBSERVED' WHEN n < 100
  THEN 'CRITICAL_SUBGROUP_INSUFFICIENT_SUPPORT' ELSE 'SUPPORTED' END AS finding FROM Q LEFT JOIN C ON Q.grp = C.grp""",
)
def required_subgroups(spark, sf):
    from evenhand.catalog.registry import table

    d = table(spark, sf, "documents").select("lang", "n_chars")
    required = d.select(
        F.concat("lang", F.when(F.col("n_chars") > 15000, "-long").otherwise("")).alias("grp")
    ).distinct()
    subgroups = M.subgroup_table(confusion_cells(document_frame(spark, sf)), M.Gates(100))
    return P.required_subgroups(subgroups, required)


# --- gate, taxonomy, review, success -----------------------------------------------------------------------

THIN = f"""TH AS (SELECT run, count(*) FILTER (WHERE n < 2 OR tp + fn < 1 OR tn + fp < 1) AS thin FROM C GROUP BY run)"""
STANDARD = """P1 AS (SELECT * FROM PO WHERE policy_name = 'Standard_Operational_Policy')"""


def _standard(spark, sf):
    return P.decide(source_suites(spark, sf), P.default_policies()[:1])


@query(
    "decision_gate",
    f"""{SOURCES}, {POLICY_ROWS}, {DECIDED}, {THIN},
G AS (SELECT Y.*, thin, thin + (fairness_gap IS NULL)::INT AS gate_count FROM Y JOIN TH ON Y.run = TH.run
      WHERE policy_name = 'Standard_Operational_Policy')
SELECT run, gate_count = 0 AS gate_passed, CAST(gate_count AS INT) AS gate_code_count,
  CASE WHEN gate_count > 0 THEN 'POLICY_UNDEFINED' ELSE decision END AS decision FROM G""",
)
def decision_gate(spark, sf):
    """A run without any defined gap has no estimand; thin groups close the gate."""
    estimand = F.when(F.col("fairness_gap").isNotNull(), "SPECIFIED")
    out = P.decision_gate(_standard(spark, sf), estimand_status=estimand)
    return out.select("run", "gate_passed", F.size("gate_codes").alias("gate_code_count"), "decision")


TAXONOMY = f"""TX AS (SELECT Y.*, thin, CASE WHEN degeneracy_status = 'DEGENERATE' THEN 'DEGENERATE' ELSE 'ACCEPTABLE' END AS model_status
  FROM Y JOIN TH ON Y.run = TH.run WHERE policy_name = 'Standard_Operational_Policy'),
TY AS (SELECT *, CASE WHEN model_status = 'DEGENERATE' OR thin > 0 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS evidence_status,
  CASE WHEN model_status = 'DEGENERATE' THEN 'PRECEDENCE_MODEL_DEGENERATE' WHEN thin > 0 THEN 'PRECEDENCE_EVIDENCE_INSUFFICIENT' END
    AS precedence_rule_applied,
  CASE WHEN model_status = 'DEGENERATE' THEN 'FAIL' WHEN thin > 0 THEN 'NOT_EVALUABLE'
       WHEN decision = 'POLICY_COMPLIANT' THEN 'PASS' ELSE 'FAIL' END AS policy_status FROM TX)"""


@query(
    "status_taxonomy",
    f"""{SOURCES}, {POLICY_ROWS}, {DECIDED}, {THIN}, {TAXONOMY}
SELECT run, 'COMPLETE' AS audit_execution_status, evidence_status, model_status, policy_status, precedence_rule_applied,
  false AS is_exploratory FROM TY""",
)
def status_taxonomy(spark, sf):
    return P.taxonomy(_standard(spark, sf)).select("run", "taxonomy.*")


@query(
    "status_taxonomy_blocked",
    f"""{SOURCES} SELECT run, 'BLOCKED' AS audit_execution_status, 'INSUFFICIENT' AS evidence_status, 'INVALID' AS model_status,
  'NOT_EVALUABLE' AS policy_status, 'PRECEDENCE_EXECUTION_BLOCKED' AS precedence_rule_applied, true AS is_exploratory FROM S""",
)
def status_taxonomy_blocked(spark, sf):
    out = P.taxonomy(
        _standard(spark, sf), execution=F.lit("BLOCKED"), leakage_findings=F.lit(2),
        analysis_type=F.lit("SCREENING_ANALYSIS"),
    )
    return out.select("run", "taxonomy.*")


@query(
    "review_boundary",
    f"""{SOURCES}, {POLICY_ROWS}, {DECIDED}, {THIN}, {TAXONOMY}, Z AS (SELECT run, concat_ws(',',
  CASE WHEN policy_status = 'FAIL' THEN 'REVIEW_MATERIAL_POLICY_VIOLATION' END,
  CASE WHEN policy_status = 'NOT_EVALUABLE' OR evidence_status = 'INSUFFICIENT' THEN 'REVIEW_INCONCLUSIVE_EVIDENCE' END,
  'REVIEW_DERIVED_SENSITIVE_ATTRIBUTE', CASE WHEN thin > 0 THEN 'REVIEW_LOW_SUPPORT' END,
  CASE WHEN fairness_gap IS NULL THEN 'REVIEW_AMBIGUOUS_ESTIMAND' END, 'REVIEW_REGULATORY_MAPPING') AS reason_codes FROM TY)
SELECT run, true AS human_review_required, reason_codes FROM Z""",
)
def review_boundary(spark, sf):
    out = P.review_codes(
        P.taxonomy(_standard(spark, sf)), lineage=F.lit("DERIVED_PROXY"),
        estimand_specified=F.col("fairness_gap").isNotNull(), additional=["HIGH_STAKES_DECISION"],
    )
    return out.select(
        "run", F.col("review.human_review_required").alias("human_review_required"),
        F.concat_ws(",", "review.reason_codes").alias("reason_codes"),
    )


@query(
    "review_notes",
    f"""{SOURCES}, {POLICY_ROWS}, {DECIDED}, {THIN}, {TAXONOMY}, Z AS (SELECT run, thin, unnest(list_filter([
  CASE WHEN policy_status = 'FAIL' THEN 'REVIEW_MATERIAL_POLICY_VIOLATION' END,
  CASE WHEN policy_status = 'NOT_EVALUABLE' OR evidence_status = 'INSUFFICIENT' THEN 'REVIEW_INCONCLUSIVE_EVIDENCE' END,
  CASE WHEN thin > 0 THEN 'REVIEW_LOW_SUPPORT' END, 'REVIEW_UNIT_MISMATCH', 'REVIEW_BOARD'], lambda c: c IS NOT NULL)) AS code FROM TY),
NT AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.REVIEW_NOTES.items())}) v(code, note))
SELECT run, Z.code, CASE WHEN Z.code = 'REVIEW_LOW_SUPPORT' THEN 'groups' ELSE coalesce(note, 'Asked for by the caller: ' || Z.code) END AS note FROM Z LEFT JOIN NT USING (code)""",
)
def review_notes(spark, sf):
    """Each reason with its note; of the note on thin groups only that it names as many as there are."""
    out = P.review_codes(P.taxonomy(_standard(spark, sf)), unit_mismatch=F.lit(True), additional=["REVIEW_BOARD"])
    pairs = out.select("run", F.size(F.filter("subgroups", lambda g: g["support_status"] == "INSUFFICIENT_GROUP_SUPPORT")).alias("thin"),
                       F.explode(F.arrays_zip("review.reason_codes", "review.notes")).alias("p"))
    code, note = F.col("p.reason_codes"), F.col("p.notes")
    names = F.size(F.split(F.element_at(F.split(note, ": "), -1), ", "))
    return pairs.select("run", code.alias("code"), F.when((code == "REVIEW_LOW_SUPPORT") & (names == F.col("thin")), "groups").otherwise(note).alias("note"))


@query(
    "success_class",
    f"""{PRIORITIES} SELECT run, CASE WHEN overall_status <> 'VALID' THEN 'UNDEFINED'
  WHEN eodds_value <= 0.05 AND dp_value <= 0.1 AND degeneracy_status = 'NORMAL' AND balanced_accuracy >= 0.5 THEN 'FAIR_AND_USEFUL'
  WHEN degeneracy_status = 'NORMAL' AND balanced_accuracy >= 0.5 THEN 'UNFAIR_AND_USEFUL'
  WHEN eodds_value <= 0.05 AND dp_value <= 0.1 THEN 'FAIR_BUT_DEGENERATE' ELSE 'UNFAIR_AND_DEGENERATE' END AS success FROM S""",
)
def success_class(spark, sf):
    s = priority_suites(spark, sf)
    return s.select("run", P.success_class(F.lit(0.5), F.lit(0.05)).alias("success"))


# --- report privacy --------------------------------------------------------------------------------------------

@query(
    "report_privacy",
    f"""WITH {DOC_SQL}, C AS (SELECT source AS run, grp, {CELLS} FROM D GROUP BY source, grp),
K AS (SELECT run, grp, n, row_number() OVER (PARTITION BY run ORDER BY n DESC, grp) AS r FROM C WHERE n >= 4)
SELECT run, 'REDACTED_GROUP_' || lpad(CAST(r AS VARCHAR), 3, '0') AS grp, n FROM K WHERE r <= 3""",
)
def report_privacy(spark, sf):
    out = P.govern_report(source_suites(spark, sf), "REDACTED_EXTERNAL", 4, max_groups=3, mask_labels=True)
    return out.select("run", F.explode("subgroups").alias("g")).select("run", "g.grp", "g.n")


@query(
    "report_privacy_metadata",
    f"""WITH {DOC_SQL}, C AS (SELECT source AS run, grp, {CELLS} FROM D GROUP BY source, grp),
K AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE n >= 4) AS big FROM C GROUP BY run)
SELECT run, 'FULL_INTERNAL' AS privacy_mode, false AS suppression_applied, 0 AS suppressed_groups_count,
  CAST(total AS INT) AS disclosed_groups_count FROM K UNION ALL
SELECT run, 'SUMMARY_ONLY', true, CAST(total AS INT), 0 FROM K UNION ALL
SELECT run, 'REDACTED_EXTERNAL', total > big, CAST(total - big AS INT), CAST(big AS INT) FROM K""",
)
def report_privacy_metadata(spark, sf):
    s = source_suites(spark, sf)
    out = None
    for mode in ("FULL_INTERNAL", "SUMMARY_ONLY", "REDACTED_EXTERNAL"):
        part = P.govern_report(s, mode, 4).select(
            "run", "privacy.privacy_mode", "privacy.suppression_applied", "privacy.suppressed_groups_count",
            "privacy.disclosed_groups_count",
        )
        out = part if out is None else out.unionByName(part)
    return out
