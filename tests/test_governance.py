import json

import pytest
from pyspark.sql import functions as F

from evenhand.operators import metrics as M
from evenhand.operators import units as U
from evenhand.plans import documents as D
from evenhand.plans import policy as P
from evenhand.plans import report as T
from evenhand.plans.evaluate import AuditConfig, attach_uncertainty, evaluate

PLAIN = AuditConfig(gates=M.Gates(2), with_auc=False)


def good(frame, flips=0):
    """50 + 50 rows, right but for ``flips`` rows of group B."""
    y = [i % 2 for i in range(100)]
    p = [1 - v if i >= 50 and i - 50 < flips else v for i, v in enumerate(y)]
    return frame(y, p, ["A"] * 50 + ["B"] * 50)


def decide(df, policy=P.Policy(), config=PLAIN):
    return P.decide(evaluate(df, config), [policy])


def test_compliant_and_floor(frame):
    ok = decide(good(frame, flips=1)).first()
    assert ok.decision == "POLICY_COMPLIANT" and ok.evidence_state == "PASS" and ok.policy_passed
    assert ok.reason_codes == ["ALL_POLICY_RULES_SATISFIED"]
    floor = P.Policy(min_subgroup_balanced_accuracy=0.85, max_equalized_odds=None, max_demographic_parity=None, min_disparate_impact=None)
    r = decide(good(frame, flips=10), floor).first()
    assert r.balanced_accuracy == pytest.approx(0.90) and r.decision == "POLICY_NONCOMPLIANT"
    assert r.reason_codes == ["SUBGROUP_BALANCED_ACCURACY_BELOW_MINIMUM"]


@pytest.mark.parametrize("pred", [lambda y, i: 1, lambda y, i: 0, lambda y, i: 1 if i else 0])
def test_degenerate_predictors_never_comply(frame, pred):
    y = [i % 2 for i in range(100)]
    df = frame(y, [pred(v, i) for i, v in enumerate(y)], ["A", "B"] * 50)
    r = P.taxonomy(decide(df)).first()
    assert r.decision == "POLICY_DEGENERATE" and r.reason_codes[0] == "MODEL_DEGENERATE"
    assert r.taxonomy.policy_status == "FAIL" and r.taxonomy.precedence_rule_applied == "PRECEDENCE_MODEL_DEGENERATE"


def test_missing_groups_abstain(frame):
    y = [0, 1] * 20
    df = frame(y, y, ["A"] * 20 + ["B"] * 18 + [None, "unknown"])
    r = decide(df).first()
    assert r.overall_status == "MISSING_ATTRIBUTE_VIOLATION" and r.decision == "POLICY_UNDEFINED"
    assert "MISSING_SENSITIVE_ATTRIBUTE" in r.reason_codes
    kept = evaluate(df, AuditConfig(gates=M.Gates(2), missing_policy="EXCLUDE", with_auc=False)).first()
    assert kept.overall_status == "VALID" and kept.sample_size == 38 and kept.missing_handling.missing_count == 2


def test_ratio_gate_conflict(frame):
    y = [1] * 25 + [0] * 25
    df = frame(y * 2, [1] * 45 + [0] * 5 + [1] * 20 + [0] * 30, ["A"] * 50 + ["B"] * 50)
    r = evaluate(df, PLAIN).first()
    assert r.di_value == pytest.approx(20 / 45)


def test_critical_and_required_subgroups(frame):
    pol = P.Policy(critical_subgroups=("A", "Z"), require_subgroup_support=True)
    r = decide(good(frame), pol, AuditConfig(gates=M.Gates(60), with_auc=False)).first()
    assert {"CRITICAL_SUBGROUP_UNOBSERVED", "CRITICAL_SUBGROUP_INSUFFICIENT_SUPPORT", "SUBGROUP_INSUFFICIENT_SUPPORT"} <= set(r.reason_codes)
    assert r.decision == "POLICY_UNDEFINED"


def test_majority_and_version_checks(frame):
    s = evaluate(good(frame), PLAIN).withColumn("majority_balanced_accuracy", F.lit(1.0))
    r = P.decide(s, [P.Policy(policy_version=" ")]).first()
    assert "BELOW_MAJORITY_BASELINE" in r.reason_codes and "GATE_UNIDENTIFIED_POLICY_VERSION" in r.reason_codes
    assert r.decision == "POLICY_UNDEFINED"


def test_gate_and_taxonomy(frame):
    d = decide(good(frame))
    shut = P.decision_gate(d).first()
    assert shut.gate_codes == ["GATE_MISSING_ESTIMAND"] and shut.decision == "POLICY_UNDEFINED" and not shut.policy_passed
    opened = P.decision_gate(d, estimand_status=F.lit("SPECIFIED"))
    assert opened.first().gate_passed and opened.first().decision == "POLICY_COMPLIANT"
    bad = P.decision_gate(
        d, F.lit("ESTIMAND_UNSPECIFIED"), F.lit(False), F.lit(False), F.lit(3), F.lit(False)
    ).first()
    assert bad.gate_codes == [
        "GATE_ESTIMAND_UNSPECIFIED", "GATE_INVALID_EVALUATION_UNIT", "GATE_INVALID_SPLIT", "GATE_LEAKAGE_DETECTED", "GATE_INVARIANT_VIOLATION",
    ]
    t = P.taxonomy(P.decision_gate(d), gate_passed=F.col("gate_passed")).first().taxonomy
    assert (t.policy_status, t.precedence_rule_applied) == ("NOT_EVALUABLE", "PRECEDENCE_CONFIRMATORY_REQUIREMENTS_UNMET")
    passed = P.taxonomy(d).first().taxonomy
    assert passed.policy_status == "PASS" and passed.evidence_status == "SUFFICIENT"
    leaked = P.taxonomy(d, leakage_findings=F.lit(1)).first().taxonomy
    assert (leaked.model_status, leaked.policy_status) == ("INVALID", "NOT_EVALUABLE")


def test_review_codes(frame):
    t = P.taxonomy(decide(good(frame)))
    assert P.review_codes(t).first().review.human_review_required is False
    r = P.review_codes(
        t, lineage=F.lit("IMPUTED"), estimand_specified=F.lit(False), timing_features=F.lit(True), unit_mismatch=F.lit(True),
        policy_ambiguity=F.lit(True), additional=["SHIFT_DETECTED", "POLICY_AMBIGUITY", "CUSTOM"],
    ).first().review
    assert r.reason_codes == [
        "REVIEW_DERIVED_SENSITIVE_ATTRIBUTE", "REVIEW_AMBIGUOUS_ESTIMAND", "REVIEW_FEATURE_TIMING", "REVIEW_UNIT_MISMATCH",
        "REVIEW_POLICY_AMBIGUITY", "REVIEW_INCONCLUSIVE_EVIDENCE", "CUSTOM",
    ]


def test_success_class(frame):
    s = evaluate(good(frame), PLAIN)
    assert s.select(P.success_class(F.lit(0.55), F.lit(0.1))).first()[0] == "FAIR_AND_USEFUL"
    assert s.select(P.success_class(F.lit(2.0), F.lit(0.1))).first()[0] == "FAIR_BUT_DEGENERATE"


def test_default_sensitivity(frame):
    out = {r.policy.name: r.decision for r in P.decide(evaluate(good(frame, flips=6), PLAIN)).collect()}
    assert out["Strict_Equalized_Odds_Policy"] == "POLICY_NONCOMPLIANT" and out["Lenient_Diagnostic_Policy"] == "POLICY_COMPLIANT"


def test_uncertainty_reaches_the_policy(frame):
    df = good(frame)
    cfg = AuditConfig(gates=M.Gates(2), uncertainty=True, replicates=60, with_auc=False)
    s = attach_uncertainty(evaluate(df, cfg), df, cfg)
    r = s.first()
    assert r.intervals["Demographic Parity Diff"].support_status == "VALID"
    thin = s.withColumn(
        "intervals",
        F.transform_values("intervals", lambda k, v: v.withField("support_status", F.lit("INSUFFICIENT_BOOTSTRAP_SUPPORT"))),
    )
    d = P.decide(thin, [P.Policy()]).first()
    assert d.decision == "POLICY_UNDEFINED" and d.reason_codes.count("INSUFFICIENT_BOOTSTRAP_SUPPORT") == 3


def test_entity_unit_guard_in_evaluation(frame):
    df = good(frame).withColumn("entity_id", F.floor(F.col("row_id") / 2))
    cfg = AuditConfig(unit_level="TRIP_LEVEL", unit_key="entity_id", uncertainty=True)
    with pytest.raises(U.UnitMismatchError):
        evaluate(df, cfg)
    weighted = evaluate(df, AuditConfig(unit_level="TRIP_LEVEL", unit_key="entity_id", strategy="ENTITY_WEIGHTED", gates=M.Gates(2)))
    assert weighted.first().accuracy == pytest.approx(1.0)
    one = evaluate(df, AuditConfig(unit_level="TRIP_LEVEL", unit_key="entity_id", strategy="MAJORITY_VOTE", gates=M.Gates(2)))
    assert one.first().sample_size == 50


def test_privacy_modes(frame):
    df = good(frame).unionByName(frame([0, 1, 0], [0, 1, 1], ["C"] * 3))
    s = evaluate(df, PLAIN)
    full = P.govern_report(s).first()
    assert full.privacy.disclosed_groups_count == 3 and not full.privacy.suppression_applied
    none = P.govern_report(s, "SUMMARY_ONLY").first()
    assert none.subgroups == [] and none.privacy.suppressed_groups_count == 3
    red = P.govern_report(s, "REDACTED_EXTERNAL", 10, mask_labels=True).first()
    assert [g.grp for g in red.subgroups] == ["REDACTED_GROUP_001", "REDACTED_GROUP_002"]
    assert red.privacy.suppressed_groups_count == 1 and red.privacy.suppression_applied


# --- documents ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def document(spark, frame):
    d = P.govern_report(P.review_codes(P.taxonomy(decide(good(frame, flips=2)))))
    return D.documents_as_json(D.build_documents(d, "trips", "rule", "2026-01-01T00:00:00Z")).first()


def check(spark, text):
    return sorted(r.error for r in D.validate_documents(spark.createDataFrame([("r", text)], "run string, document string")).collect())


def test_document_is_sound_and_complete(spark, document):
    doc = json.loads(document.document)
    assert sorted(doc) == sorted(D.REQUIRED_SECTIONS) and list(doc) == sorted(doc)
    assert check(spark, document.document) == []
    assert doc["policy_compliance"]["policy_passed"] is True and len(doc["audit_fingerprint"]) == 64


def test_document_fingerprint(frame, document):
    d = P.govern_report(P.review_codes(P.taxonomy(decide(good(frame, flips=2)))))
    later = D.documents_as_json(D.build_documents(d, "trips", "rule", "2027-05-05T00:00:00Z")).first()
    other = D.documents_as_json(D.build_documents(d, "tripz", "rule", "2026-01-01T00:00:00Z")).first()
    fp = lambda r: json.loads(r.document)["audit_fingerprint"]
    assert fp(later) == fp(document) != fp(other)


def test_broken_documents(spark, document):
    def edit(fn):
        doc = json.loads(document.document)
        fn(doc)
        return check(spark, json.dumps(doc))

    assert edit(lambda d: d.pop("dataset")) == ["MISSING_SECTION:dataset"]
    assert edit(lambda d: d["dataset"].update(entity_count=0)) == ["ENTITY_COUNT_BELOW_ONE", "INVALID_COUNT_IDENTITY:dataset"]
    assert edit(lambda d: d["subgroup_evaluations"]["B"].update(TP=99)) == [
        "INVALID_COUNT_IDENTITY:B", "INVALID_METRIC_IDENTITY:B", "INVALID_METRIC_IDENTITY:B",
    ]
    assert edit(lambda d: d["fairness_metrics"].update(demographic_parity_difference=0.9)) == [
        "INVALID_METRIC_IDENTITY:demographic_parity_difference"
    ]
    assert edit(lambda d: d["policy_compliance"]["taxonomy_state"].update(policy_status="MAYBE")) == ["INVALID_TAXONOMY:policy_status"]
    assert edit(lambda d: d["sensitive_attributes"][0].update(lineage="IMPUTED")) == ["UNDOCUMENTED_PROXY"]
    assert edit(lambda d: d["evaluation_scope"].update(purpose="")) == ["MISSING_FIELD:evaluation_scope.purpose"]
    unit = lambda d: d["evaluation_unit_alignment"].update(evaluation_decision_unit="TRIP_LEVEL")
    assert edit(unit) == ["INVALID_UNIT_ALIGNMENT"]
    estimand = lambda d: d["evaluation_unit_alignment"]["statistical_estimand"].update(estimand_status="NO")
    assert edit(estimand) == ["MISSING_ESTIMAND"]


def test_older_document_layout(spark, document):
    """Taxonomy and review at the top level are still found and checked."""
    doc = json.loads(document.document)
    doc["taxonomy_state"] = doc["policy_compliance"].pop("taxonomy_state")
    doc["taxonomy_state"]["model_status"] = "GREAT"
    assert check(spark, json.dumps(doc)) == ["INVALID_TAXONOMY:model_status"]


def test_manifest_fingerprint_ignores_volatile(frame):
    d = decide(good(frame))
    make = lambda **kw: D.evaluation_manifests(d, {"a": F.lit(1), "b": F.lit(None).cast("string"), **kw}).first()
    assert make().fingerprint == make().fingerprint and make().evaluation_id != make().evaluation_id
    assert make().fingerprint != make(c=F.lit("x")).fingerprint


# --- run tables ---------------------------------------------------------------------------------------------

def test_paired_deltas_and_summary(spark):
    rows = [
        ("GROUP_HOLDOUT", "B1", 42, 0.8, 0.20), ("GROUP_HOLDOUT", "B1", 43, 0.9, 0.18), ("GROUP_HOLDOUT", "B1", 44, 0.5, 0.5),
        ("GROUP_HOLDOUT", "B3", 42, 0.8, 0.10), ("GROUP_HOLDOUT", "B3", 43, 0.9, 0.08), ("IID_HOLDOUT", "B3", 44, 0.1, 0.9),
    ]
    df = spark.createDataFrame(rows, "regime string, baseline_id string, seed int, accuracy double, eodds_value double")
    got = {r.metric: r for r in T.paired_deltas(df, "B1", "B3", "GROUP_HOLDOUT").collect()}
    assert got["eodds_value"].seeds_count == 2 and got["eodds_value"].mean_paired_delta == pytest.approx(-0.10)
    assert got["accuracy"].std_paired_delta == 0.0
    s = {(r.baseline_id, r.metric): r for r in T.seed_summary(T.run_rows(df, ["baseline_id"], ["accuracy"]), ["baseline_id"]).collect()}
    b1 = s[("B1", "accuracy")]
    assert b1.runs == 3 and b1.median == 0.8 and b1.std == pytest.approx(0.16996731711975951)
    closed = T.canonical_summary(T.run_rows(df.limit(1), ["baseline_id"], ["accuracy"]), ["baseline_id"]).first()
    assert closed.ci95_low == closed.ci95_high == 0.8


def test_observed_vs_expected(frame, spark):
    from evenhand.operators.cells import confusion_cells

    expected = spark.createDataFrame([("A", 0.4), ("B", 0.5), ("C", 0.1)], "grp string, expected_rate double")
    out = T.observed_vs_expected(confusion_cells(good(frame)), expected)
    assert {r.grp: r.error for r in out.collect()} == {"A": pytest.approx(0.1), "B": pytest.approx(0.0), "C": None}
    g = T.base_rate_gap_error(out, "A", "B").first()
    assert g.gap_error == pytest.approx(0.1)
