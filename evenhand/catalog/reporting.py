"""Seed summaries, paired deltas, slices, comparisons, registries, documents, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.governance import NO_AUC, PRIORITIES, SOURCES, priority_suites, source_suites
from evenhand.catalog.metric_core import PERFORMANCE
from evenhand.catalog.registry import (
    CELLS, DOC_SQL, EVENT_SQL, LINE_SQL, TOTAL, cells_sql, disparity_sql, document_frame, event_frame, line_frame,
    query, rates_sql, table,
)
from evenhand.operators import metrics as M
from evenhand.operators.cells import confusion_cells
from evenhand.plans import documents as D
from evenhand.plans import policy as P
from evenhand.plans import report as T
from evenhand.plans.evaluate import AuditConfig, evaluate
from evenhand.sources import registry as G
from evenhand.sources import sinks as S

# --- run tables -------------------------------------------------------------------------------

RUNS_SQL = f"""WITH {LINE_SQL}, C AS (SELECT priority AS baseline_id, year(ts) AS seed, grp, {CELLS} FROM L
  GROUP BY priority, year(ts), grp), {rates_sql()}, {disparity_sql(by="baseline_id, seed", size=1)},
TT AS (SELECT baseline_id, seed, {TOTAL} FROM C GROUP BY baseline_id, seed),
PF AS (SELECT baseline_id, seed, {PERFORMANCE} FROM TT),
RUNS AS (SELECT PF.*, W.dp_value, W.eodds_value, W.di_value, W.dp_status, W.eodds_status FROM PF
  JOIN W ON PF.baseline_id = W.baseline_id AND PF.seed = W.seed)"""
MEASURES = ["accuracy", "balanced_accuracy", "dp_value", "eodds_value", "di_value"]
LONG_SQL = "LG AS (" + " UNION ALL ".join(
    f"SELECT baseline_id, seed, '{m}' AS metric, {m} AS value FROM RUNS" for m in MEASURES
) + ")"


def runs(spark, sf):
    """Order priority as the baseline and the shipping year as the seed."""
    frame = line_frame(spark, sf).select(
        "y_true", "y_pred", "grp", F.col("priority").alias("baseline_id"), F.year("ts").alias("seed")
    )
    return evaluate(frame, AuditConfig(by=("baseline_id", "seed"), gates=M.Gates(1), **NO_AUC))


@query("run_rows", f"{RUNS_SQL}, {LONG_SQL} SELECT baseline_id, CAST(seed AS INT) AS seed, metric, value FROM LG")
def run_rows(spark, sf):
    return T.run_rows(runs(spark, sf), ["baseline_id", "seed"], MEASURES)


@query(
    "flat_runs",
    f"{RUNS_SQL} SELECT baseline_id, CAST(seed AS INT) AS seed, accuracy, balanced_accuracy, dp_value, eodds_value, di_value FROM RUNS",
)
def flat_runs(spark, sf):
    return T.flat_runs(T.run_rows(runs(spark, sf), ["baseline_id", "seed"], MEASURES), ["baseline_id", "seed"], MEASURES)


SPREAD_SQL = """SELECT baseline_id, metric, count(value) AS runs, round(avg(value), 8) AS mean,
  round(quantile_cont(value, 0.5), 8) AS median, round(stddev_pop(value), 8) AS std, round(min(value), 8) AS min,
  round(max(value), 8) AS max,
  round(CASE WHEN count(value) > 1 AND stddev_pop(value) > 1e-9
        THEN avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)) {low} END, 8) AS ci95_low,
  round(CASE WHEN count(value) > 1 AND stddev_pop(value) > 1e-9
        THEN avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)) {low} END, 8) AS ci95_high
FROM LG WHERE value IS NOT NULL GROUP BY baseline_id, metric"""


def _rounded(df):
    names = {"mean", "median", "std", "min", "max", "ci95_low", "ci95_high"}
    return df.select(*[F.round(c, 8).alias(c) if c in names else F.col(c) for c in df.columns])


@query("multi_seed_summary", f"{RUNS_SQL}, {LONG_SQL} {SPREAD_SQL.format(low='')}")
def multi_seed_summary(spark, sf):
    rows = T.run_rows(runs(spark, sf), ["baseline_id", "seed"], MEASURES)
    return _rounded(T.seed_summary(rows, ["baseline_id"]))


@query("canonical_summary", f"{RUNS_SQL}, {LONG_SQL} {SPREAD_SQL.format(low='ELSE avg(value)')}")
def canonical_summary(spark, sf):
    rows = T.run_rows(runs(spark, sf), ["baseline_id", "seed"], MEASURES)
    return _rounded(T.canonical_summary(rows, ["baseline_id"]))


@query(
    "status_summary",
    f"""{RUNS_SQL}, K AS (SELECT baseline_id, eodds_status, count(*) AS k FROM RUNS GROUP BY baseline_id, eodds_status),
B AS (SELECT baseline_id, eodds_status, row_number() OVER (PARTITION BY baseline_id ORDER BY k DESC, eodds_status) AS r FROM K)
SELECT baseline_id, (SELECT count(*) FROM RUNS x WHERE x.baseline_id = B.baseline_id) AS seeds_count, eodds_status FROM B WHERE r = 1""",
)
def status_summary(spark, sf):
    return T.status_summary(runs(spark, sf), ["baseline_id"], ["eodds_status"])


@query(
    "paired_deltas",
    f"""{RUNS_SQL}, {LONG_SQL}, DL AS (SELECT a.metric, b.value - a.value AS d FROM LG a JOIN LG b ON a.seed = b.seed
  AND a.metric = b.metric AND a.baseline_id = '1-URGENT' AND b.baseline_id = '5-LOW')
SELECT metric, '1-URGENT' AS baseline_reference, '5-LOW' AS baseline_comparison, count(*) AS seeds_count,
  round(avg(d), 8) AS mean_paired_delta, round(CASE WHEN count(d) > 1 THEN stddev_samp(d) ELSE 0 END, 8) AS std_paired_delta,
  round(quantile_cont(d, 0.5), 8) AS median_paired_delta, round(min(d), 8) AS min_paired_delta,
  round(max(d), 8) AS max_paired_delta FROM DL GROUP BY metric""",
)
def paired_deltas(spark, sf):
    out = T.paired_deltas(runs(spark, sf), "1-URGENT", "5-LOW", metrics=MEASURES)
    return out.select(*[F.round(c, 8).alias(c) if c.endswith("delta") else F.col(c) for c in out.columns])


@query(
    "subgroup_summary",
    f"""WITH {LINE_SQL}, X AS (SELECT 'segment' AS dimension, grp AS value, y_true, y_pred FROM L UNION ALL
  SELECT 'priority', priority, y_true, y_pred FROM L UNION ALL
  SELECT 'quantity', CASE WHEN weight > 0 AND weight <= 10 THEN 'small' WHEN weight > 10 AND weight <= 30 THEN 'middle'
    ELSE 'nan' END, y_true, y_pred FROM L)
SELECT dimension, value, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS accuracy,
  avg(y_pred) AS positive_rate FROM X GROUP BY dimension, value""",
)
def subgroup_summary(spark, sf):
    from evenhand.operators.frames import fixed_bins

    return T.subgroup_summary(
        line_frame(spark, sf),
        {
            "segment": F.col("grp"),
            "priority": F.col("priority"),
            "quantity": fixed_bins("weight", [0, 10, 30], ["small", "middle"]),
        },
    )


ZERO = """SELECT slice, model, max(s) - min(s) AS dp, max(t) - min(t) AS eo, greatest(max(t) - min(t), max(f) - min(f)) AS odds,
  max(p) - min(p) AS pp FROM (SELECT slice, model, selection_rate AS s, coalesce(tpr, 0) AS t, coalesce(fpr, 0) AS f,
  coalesce(ppv, 0) AS p FROM R) GROUP BY slice, model"""


@query(
    "robustness_slices",
    f"""WITH {EVENT_SQL}, MD AS (SELECT quantile_cont(value, 0.5) AS m FROM E),
X AS (SELECT *, CASE WHEN value <= m THEN 'Time Split (Early)' ELSE 'Time Split (Late)' END AS half,
  CASE WHEN value > 20 THEN 1 ELSE 0 END AS alt FROM E, MD),
Y AS (SELECT 'Unseen Holdout' AS slice, * FROM X UNION ALL SELECT half, * FROM X),
Z AS (SELECT slice, 'a' AS model, grp, y_true, y_pred FROM Y UNION ALL SELECT slice, 'b', grp, y_true, alt FROM Y),
C AS (SELECT slice, model, grp, {CELLS} FROM Z GROUP BY slice, model, grp), {rates_sql()}, G AS ({ZERO}),
A AS (SELECT slice, model, sum(tp + tn) / sum(n) AS acc FROM C GROUP BY slice, model),
J AS (SELECT A.slice, A.model, acc, (dp + eo + odds + pp) / 4 AS gap FROM A JOIN G ON A.slice = G.slice AND A.model = G.model)
SELECT slice, max(acc) FILTER (WHERE model = 'a') AS baseline_accuracy, max(acc) FILTER (WHERE model = 'b') AS mitigated_accuracy,
  round(max(gap) FILTER (WHERE model = 'a'), 9) AS baseline_gap, round(max(gap) FILTER (WHERE model = 'b'), 9) AS mitigated_gap,
  'events' AS dataset FROM J GROUP BY slice""",
)
def robustness_slices(spark, sf):
    frame = event_frame(spark, sf).withColumn("alt", F.when(F.col("value") > 20, 1).otherwise(0))
    out = T.robustness_slices(frame, "value", "y_pred", "alt", "events")
    return out.withColumn("baseline_gap", F.round("baseline_gap", 9)).withColumn("mitigated_gap", F.round("mitigated_gap", 9))


EXPECTED = [("AUTOMOBILE", 0.30), ("BUILDING", 0.35), ("FURNITURE", 0.25), ("SPACE", 0.10)]


@query(
    "observed_vs_expected",
    f"""WITH {LINE_SQL}, {cells_sql("L")}, X(grp, expected_rate) AS (VALUES ('AUTOMOBILE', 0.30::DOUBLE), ('BUILDING', 0.35::DOUBLE),
  ('FURNITURE', 0.25::DOUBLE), ('SPACE', 0.10::DOUBLE))
SELECT coalesce(C.grp, X.grp) AS grp, expected_rate, pos_n / n AS observed_rate, pos_n / n - expected_rate AS error
FROM C FULL OUTER JOIN X ON C.grp = X.grp""",
)
def observed_vs_expected(spark, sf):
    expected = spark.createDataFrame(EXPECTED, "grp string, expected_rate double")
    return T.observed_vs_expected(confusion_cells(line_frame(spark, sf)), expected)


@query(
    "base_rate_gap_error",
    f"""WITH {LINE_SQL}, {cells_sql("L")}, G AS (SELECT max(pos_n / n) FILTER (WHERE grp = 'AUTOMOBILE')
  - max(pos_n / n) FILTER (WHERE grp = 'BUILDING') AS g FROM C)
SELECT g AS observed_gap, 0.30::DOUBLE - 0.35::DOUBLE AS expected_gap, g - (0.30::DOUBLE - 0.35::DOUBLE) AS gap_error FROM G""",
)
def base_rate_gap_error(spark, sf):
    expected = spark.createDataFrame(EXPECTED, "grp string, expected_rate double")
    compared = T.observed_vs_expected(confusion_cells(line_frame(spark, sf)), expected)
    return T.base_rate_gap_error(compared, "AUTOMOBILE", "BUILDING")


@query(
    "subgroup_rows",
    f"""WITH {DOC_SQL}, C AS (SELECT source AS run, grp, {CELLS} FROM D GROUP BY source, grp), {rates_sql()}
SELECT run, grp, n, selection_rate, tpr, fpr, ppv FROM R""",
)
def subgroup_rows(spark, sf):
    return T.subgroup_rows(source_suites(spark, sf), ["run"]).select("run", "grp", "n", "selection_rate", "tpr", "fpr", "ppv")


@query(
    "provenance_lookup",
    """SELECT source, count(*) AS n, CASE WHEN source LIKE '%1' THEN 'REAL_OBSERVED' WHEN source LIKE '%2' THEN 'DERIVED_PROXY' END
  AS sensitive_origin FROM documents GROUP BY source""",
)
def provenance_lookup(spark, sf):
    """Every source looked up in a registry; unknown sources keep NULL."""
    d = table(spark, sf, "documents")
    names = d.select("source").distinct()
    records = names.filter(F.col("source").rlike("[12]$")).select(
        F.col("source").alias("dataset_name"),
        F.when(F.endswith("source", F.lit("1")), "REPORTED_DEMOGRAPHIC").otherwise("DERIVED_PROXY").alias("sensitive_origin"),
    )
    registry = G.canonical_origins(records)
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return G.lookup(counts, registry, "source").select("source", "n", "sensitive_origin")


@query(
    "registry_file",
    """SELECT source, count(*) AS n, CASE WHEN source LIKE '%1' THEN 'REAL_DATA' WHEN source LIKE '%2' THEN 'SYNTHETIC' END AS dataset_type,
  CASE WHEN source LIKE '%1' THEN 'REAL_OBSERVED' WHEN source LIKE '%2' THEN 'DERIVED_PROXY' END AS sensitive_origin,
  CASE WHEN source LIKE '%1' OR source LIKE '%2' THEN 'RESTRICTED' END AS redistribution_status FROM documents GROUP BY source""",
)
def registry_file(spark, sf):
    """The sources of all documents against a registry file; the file has the older spellings and leaves out defaults."""
    d = table(spark, sf, "documents")
    known = d.select("source").distinct().filter(F.col("source").rlike("[12]$"))
    real = F.endswith("source", F.lit("1"))
    entry = F.concat(
        F.lit("  "), "source", F.lit(": {dataset_name: "), "source", F.lit(", dataset_type: "), F.when(real, "REAL_EXTERNAL").otherwise("SYNTHETIC"),
        F.lit(", sensitive_origin: "), F.when(real, "REPORTED_DEMOGRAPHIC").otherwise("DERIVED_PROXY"), F.lit("}\n"),
    )
    path = S.scratch_path(spark, "registry")
    whole = known.agg(F.concat(F.lit("provenance_records:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("value"))  # a line per source
    whole.coalesce(1).write.text(path)
    registry = G.load_provenance(spark, path).select("dataset_name", "dataset_type", "sensitive_origin", "redistribution_status")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return G.lookup(counts, registry, "source").select("source", "n", "dataset_type", "sensitive_origin", "redistribution_status")


# --- documents ------------------------------------------------------------------------------------

def governed(suites):
    decided = P.decide(suites, [P.Policy()])
    return P.govern_report(P.review_codes(P.taxonomy(decided)))


@query("audit_document")
def audit_document(spark, sf):
    """Nested documents as JSON with fingerprints (SHA over JSON has no SQL twin)."""
    return D.documents_as_json(D.build_documents(governed(source_suites(spark, sf)), "documents", "length rule", "2026-01-01T00:00:00Z"))


@query(
    "audit_document_values",
    f"""{SOURCES} SELECT run, n AS total_records, accuracy, dp_value, di_value, degeneracy_status <> 'NORMAL' AS degenerate,
  groups AS subgroup_count FROM S""",
)
def audit_document_values(spark, sf):
    """Values read back from the JSON text of the documents."""
    docs = D.documents_as_json(D.build_documents(governed(source_suites(spark, sf)), "documents", "length rule", "2026-01-01T00:00:00Z"))
    j = lambda p, t: F.expr(f"try_cast(get_json_object(document, '$.{p}') AS {t})")
    return docs.select(
        "run",
        j("dataset.total_records", "bigint").alias("total_records"),
        j("global_performance.accuracy", "double").alias("accuracy"),
        j("fairness_metrics.demographic_parity_difference", "double").alias("dp_value"),
        j("fairness_metrics.disparate_impact_ratio", "double").alias("di_value"),
        F.contains("document", F.lit("MODEL_DEGENERATE")).alias("degenerate"),
        j("intersectional_evaluations.total_intersectional_groups", "bigint").alias("subgroup_count"),
    )


@query(
    "document_validation",
    f"""{SOURCES}, Q AS (SELECT run, n FROM S)
SELECT run, 'INVALID_SCHEMA_VERSION' AS error FROM Q WHERE n % 4 = 0 UNION ALL
SELECT run, 'MISSING_SECTION:privacy_governance' FROM Q WHERE n % 4 = 1 UNION ALL
SELECT run, 'INVALID_LINEAGE' FROM Q WHERE n % 4 = 2 UNION ALL
SELECT run, 'PRIVACY_DISCLAIMER_UNCLEAR' FROM Q WHERE n % 4 = 2""",
)
def document_validation(spark, sf):
    """Documents damaged in a way that follows from their size; a quarter stay sound."""
    suites = source_suites(spark, sf)
    docs = D.documents_as_json(D.build_documents(governed(suites), "documents", "length rule", "2026-01-01T00:00:00Z"))
    n = F.expr("try_cast(get_json_object(document, '$.dataset.total_records') AS bigint)")
    text = F.col("document")
    damaged = (
        F.when(n % 4 == 0, F.replace(text, F.lit('"schema_version":"1.0.0"'), F.lit('"schema_version":"one"')))
        .when(n % 4 == 1, F.replace(text, F.lit('"privacy_governance"'), F.lit('"privacy"')))
        .when(
            n % 4 == 2,
            F.replace(
                F.replace(text, F.lit('"lineage":"OBSERVED"'), F.lit('"lineage":"GUESSED"')),
                F.lit("differential privacy"), F.lit("anything else"),
            ),
        )
        .otherwise(text)
    )
    return D.validate_documents(docs.withColumn("document", damaged))


@query(
    "invariant_check",
    f"""{PRIORITIES} SELECT run, 'INVALID_METRIC_IDENTITY:disparate_impact_ratio' AS error FROM S WHERE n % 2 = 1 UNION ALL
SELECT C.run, 'INVALID_COUNT_IDENTITY:' || C.grp FROM C JOIN S ON C.run = S.run WHERE S.n % 2 = 0 AND C.grp = 'BUILDING'
UNION ALL SELECT C.run, 'INVALID_COUNT_IDENTITY:' || C.grp FROM C JOIN S ON C.run = S.run WHERE S.n % 2 = 0 AND C.grp = 'BUILDING'""",
)
def invariant_check(spark, sf):
    """Odd-sized runs report a wrong ratio, even-sized ones a wrong group size (which breaks the
    class count and the cell count)."""
    s = priority_suites(spark, sf)
    odd = F.col("sample_size") % 2 == 1
    damaged = s.withColumn("di_value", F.when(odd, F.col("di_value") / 2).otherwise(F.col("di_value"))).withColumn(
        "subgroups",
        F.transform(
            "subgroups",
            lambda g: F.when(~odd & (g["grp"] == "BUILDING"), g.withField("n", g["n"] + 7)).otherwise(g),
        ),
    )
    docs = D.documents_as_json(D.build_documents(governed(damaged), "lines", "discount rule", "2026-01-01T00:00:00Z"))
    return D.validate_documents(docs)


@query(
    "manifest_fingerprint",
    f"""{PRIORITIES} SELECT run, sha256(concat('{{"dataset_identity":"lines","evaluator_version":"1","policy_id":"POL-STD-2026.1",',
  '"random_seeds":[42],"sample_size":', n, ',"split_strategy":"stratified"}}')) AS fingerprint FROM S""",
)
def manifest_fingerprint(spark, sf):
    decided = P.decide(priority_suites(spark, sf), [P.Policy()])
    out = D.evaluation_manifests(
        decided,
        {
            "dataset_identity": F.lit("lines"), "split_strategy": F.lit("stratified"), "random_seeds": F.array(F.lit(42)),
            "evaluator_version": F.lit("1"), "policy_id": F.col("policy.policy_id"), "sample_size": F.col("sample_size"),
            "dataset_sha256": F.lit(None).cast("string"),
        },
    )
    return out.select("run", "fingerprint")
