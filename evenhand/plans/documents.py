"""Audit documents: building, fingerprints, reading, validation and metric invariants.

A document is a nested struct (one per run); a table of documents is checked by one map-only
job that yields one row per broken rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


REQUIRED_SECTIONS = [
    "schema_version", "audit_id", "timestamp", "framework_version", "evaluation_scope", "dataset",
    "sensitive_attributes", "feature_contract", "split_protocol", "model_metadata", "evaluation_unit_alignment",
    "global_performance", "fairness_metrics", "subgroup_evaluations", "intersectional_evaluations",
    "uncertainty_quantification", "multiple_comparisons", "policy_compliance", "privacy_governance",
    "audit_fingerprint",
]
LINEAGES = ["OBSERVED", "DERIVED_PROXY", "SYNTHETIC", "IMPUTED"]
POLICY_TYPES = ["ANALYTICAL", "ORGANIZATIONAL", "REGULATORY_MAPPING"]
VOLATILE = ("audit_fingerprint", "timestamp")
ESTIMAND_STATUSES = ["SPECIFIED", "UNSPECIFIED", "ESTIMAND_UNSPECIFIED", "NOT_APPLICABLE"]
TOLERANCE = 1e-3


def _sorted_struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys; NULLs stay visible."""
    return F.to_json(_sorted_struct(fields), {"ignoreNullFields": "false"})


def build_documents(
    decided: DataFrame,
    name: str | Column = "Dataset",
    model: str | Column = "Model",
    timestamp: str | None = None,
    purpose: str = "Group fairness audit",
    target_decision: str = "Binary decision",
    attribute: str = "sensitive_group",
    lineage: str = "OBSERVED",
    proxy_rule: str | None = None,
    observation_unit: str = "ROW_LEVEL",
    entity_count: Column | None = None,
    estimand_status: str = "SPECIFIED",
    split_type: str = "GROUP_ISOLATED",
    split_key: str | None = None,
    analysis_type: str = "SCREENING_ANALYSIS",
    features_present: int = 0,
    replicates: int = 0,
    key: str = "run",
) -> DataFrame:
    """``run, document`` (struct) from decided, governed, classified suite rows.

    Needs the columns of ``decide``, ``taxonomy``, ``review_codes`` and ``govern_report``.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = lambda x: lit(x).cast("string")
    g = "subgroups"
    by_grp = F.map_from_entries(
        F.transform(
            g,
            lambda s: F.struct(
                s["grp"].alias("key"),
                _sorted_struct(
                    {
                        "sample_size": s["n"],
                        "positive_count": s["positive_count"],
                        "negative_count": s["negative_count"],
                        "selection_rate": s["selection_rate"],
                        "balanced_accuracy": s["balanced_accuracy"],
                        "TP": s["tp"], "TN": s["tn"], "FP": s["fp"], "FN": s["fn"],
                        "TPR": s["tpr"], "TNR": s["tnr"], "FPR": s["fpr"], "FNR": s["fnr"], "PPV": s["ppv"],
                        "support_status": s["support_status"],
                    }
                ).alias("value"),
            ),
        )
    )
    intervals = (
        F.col("intervals") if "intervals" in decided.columns
        else F.lit(None).cast("map<string,struct<ci_low:double,ci_high:double,support_status:string,valid_fraction:double>>")
    )
    proxy = F.lit(lineage in ("DERIVED_PROXY", "IMPUTED"))
    notes = lambda effect: F.transform(
        F.filter("checks", lambda c: c["effect"] == effect), lambda c: c["reason_code"]
    )
    unit = F.col("unit_level")
    sections: dict[str, Column] = {
        "schema_version": F.lit("1.0.0"),
        "audit_id": F.concat(F.lit("AUDIT-"), F.col(key).cast("string")),
        "timestamp": text(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "framework_version": F.lit("evenhand-0.1"),
        "evaluation_scope": _sorted_struct(
            {"purpose": text(purpose), "analysis_type": text(analysis_type), "target_decision": text(target_decision),
             "intended_jurisdiction": text(None)}
        ),
        "dataset": _sorted_struct(
            {"dataset_name": text(name), "raw_observation_unit": text(observation_unit),
             "total_records": F.col("sample_size"),
             "entity_count": entity_count if entity_count is not None else F.col("sample_size")}
        ),
        "sensitive_attributes": F.array(
            _sorted_struct(
                {"attribute_name": text(attribute), "lineage": text(lineage),
                 "disclosed_categories": F.transform(g, lambda s: s["grp"]),
                 "proxy_derivation_rule": text(proxy_rule),
                 "legal_disclaimer": F.when(proxy, "A proxy is not an observed trait and supports no causal or legal claim.")}
            )
        ),
        "feature_contract": _sorted_struct(
            {"contract_name": F.concat(text(name), F.lit("_prediction_contract")), "contract_status": F.lit("VALID"),
             "features_present_count": F.lit(features_present)}
        ),
        "split_protocol": _sorted_struct(
            {"split_type": text(split_type), "split_key": text(split_key), "locked_holdout_samples": F.col("sample_size")}
        ),
        "model_metadata": _sorted_struct({"model_name": text(model)}),
        "evaluation_unit_alignment": _sorted_struct(
            {"evaluation_unit_level": unit, "aggregation_strategy": F.col("aggregation_strategy"),
             "unit_key": F.coalesce("unit_key", F.lit("row")), "divergence_from_row_level": unit != "ROW_LEVEL",
             "observational_record_unit": text(observation_unit), "evaluation_decision_unit": unit,
             "target_aggregation_strategy": F.col("target_strategy"),
             "prediction_aggregation_strategy": F.col("prediction_strategy"),
             "statistical_estimand": _sorted_struct(
                 {"decision_unit": unit, "observation_unit": text(observation_unit), "estimand_status": text(estimand_status),
                  "grouping_definition": text(attribute)}
             )}
        ),
        "global_performance": _sorted_struct(
            {c: F.col(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc",
                                   "brier_score", "expected_calibration_error")}
        ),
        "fairness_metrics": _sorted_struct(
            {"demographic_parity_difference": F.col("dp_value"), "equalized_odds_difference": F.col("eodds_value"),
             "disparate_impact_ratio": F.col("di_value"), "equal_opportunity_difference": F.col("eo_value"),
             "predictive_parity_difference": F.col("pp_value")}
        ),
        "subgroup_evaluations": by_grp,
        "intersectional_evaluations": _sorted_struct(
            {"total_intersectional_groups": F.col("groups"), "adequately_supported_groups": F.size(g),
             "sparse_groups_gated_count": F.greatest(F.lit(0), F.col("groups").cast("int") - F.size(g))}
        ),
        "uncertainty_quantification": _sorted_struct(
            {"n_bootstraps": F.lit(replicates), "cluster_key": text(split_key), "intervals": intervals}
        ),
        "multiple_comparisons": _sorted_struct(
            {"total_comparisons_count": F.col("number_of_comparisons"), "selection_bias_disclosed": F.lit(True)}
        ),
        "policy_compliance": _sorted_struct(
            {"policy_name": F.col("policy.name"), "policy_type": F.col("policy.policy_type"),
             "evidence_state": F.col("evidence_state"), "policy_passed": F.col("policy_passed"),
             "rules_satisfied": notes("pass"), "violations": notes("violation"), "abstentions": notes("abstention"),
             "taxonomy_state": F.col("taxonomy"), "human_review_boundary": F.col("review")}
        ),
        "privacy_governance": _sorted_struct(
            {"reporting_privacy_mode": F.col("privacy.privacy_mode"), "suppression_applied": F.col("privacy.suppression_applied"),
             "min_reporting_population": F.col("privacy.min_reporting_population"),
             "suppressed_groups_count": F.col("privacy.suppressed_groups_count"),
             "disclosed_groups_count": F.col("privacy.disclosed_groups_count"),
             "labels_masked": F.col("privacy.labels_masked"), "disclaimer": F.col("privacy.disclaimer")}
        ),
    }
    named = decided.select(F.col(key).alias("run"), *[c.alias(k) for k, c in sections.items()])
    stable = {k: F.col(k) for k in sections if k not in VOLATILE}
    finished = named.withColumn("audit_fingerprint", F.sha2(canonical_json(stable), 256))
    return finished.select("run", _sorted_struct({k: F.col(k) for k in REQUIRED_SECTIONS}).alias("document"))


def documents_as_json(documents: DataFrame) -> DataFrame:
    return documents.select("run", F.to_json("document", {"ignoreNullFields": "false"}).alias("document"))


# --- reading and validation -----------------------------------------------------------------------

TEXT_MAP = "map<string,string>"


def _section(top: Column, name: str) -> Column:
    return F.from_json(top[name], TEXT_MAP)


def with_sections(df: DataFrame, document: str = "document") -> DataFrame:
    """Parse documents; older ones carry taxonomy and review at the top, newer ones inside the
    policy section."""
    out = df.withColumn("top", F.from_json(document, TEXT_MAP))
    top = F.col("top")
    for s in ("evaluation_scope", "dataset", "evaluation_unit_alignment", "global_performance", "fairness_metrics",
              "policy_compliance", "privacy_governance"):
        out = out.withColumn(s, _section(top, s))
    pol = F.col("policy_compliance")
    return (
        out.withColumn("sensitive_attributes", F.from_json(top["sensitive_attributes"], f"array<{TEXT_MAP}>"))
        .withColumn("taxonomy_state", F.from_json(F.coalesce(top["taxonomy_state"], pol["taxonomy_state"]), TEXT_MAP))
        .withColumn(
            "human_review_boundary",
            F.from_json(F.coalesce(top["human_review_boundary"], pol["human_review_boundary"]), TEXT_MAP),
        )
    )


def _when(cond: Column, code: str | Column) -> Column:
    c = code if isinstance(code, Column) else F.lit(code)
    return F.when(F.coalesce(cond, F.lit(False)), F.array(c)).otherwise(F.array().cast("array<string>"))


def _fields(section: str, names: Sequence[str], filled: bool = False) -> Column:
    s = F.col(section)
    parts = [_when(s.isNull(), f"NOT_AN_OBJECT:{section}")]
    for n in names:
        gone = ~F.map_contains_key(s, n)
        if filled:
            gone = gone | (F.coalesce(s[n], F.lit("")) == "")
        parts.append(_when(gone, f"MISSING_FIELD:{section}.{n}"))
    return F.concat(*parts)


def structure_errors() -> Column:
    top = F.col("top")
    missing = F.filter(
        F.array(*[F.lit(k) for k in REQUIRED_SECTIONS]), lambda k: top[k].isNull()
    )
    missing = F.transform(missing, lambda k: F.concat(F.lit("MISSING_SECTION:"), k))
    number = lambda section, f: F.expr(f"try_cast({section}['{f}'] AS double)")

    def attribute(a: Column) -> Column:
        lineage = a["lineage"]
        undocumented = (F.coalesce(a["proxy_derivation_rule"], F.lit("")) == "") & (
            F.coalesce(a["legal_disclaimer"], F.lit("")) == ""
        )
        return F.concat(
            *[
                _when(~F.map_contains_key(a, f), f"MISSING_FIELD:sensitive_attributes.{f}")
                for f in ("attribute_name", "lineage", "disclosed_categories")
            ],
            _when(~F.coalesce(lineage, F.lit("")).isin(LINEAGES), "INVALID_LINEAGE"),
            _when(lineage.isin("DERIVED_PROXY", "IMPUTED") & undocumented, "UNDOCUMENTED_PROXY"),
        )

    tax, rev = F.col("taxonomy_state"), F.col("human_review_boundary")
    allowed = {
        "audit_execution_status": ["COMPLETE", "BLOCKED", "ABORTED"],
        "evidence_status": ["SUFFICIENT", "INSUFFICIENT"],
        "model_status": ["ACCEPTABLE", "DEGENERATE", "INVALID"],
        "policy_status": ["PASS", "FAIL", "NOT_EVALUABLE"],
    }
    disclaimer = F.lower(F.coalesce(F.col("privacy_governance")["disclaimer"], F.lit("")))
    rest = F.concat(
        _when(~top["schema_version"].rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), "INVALID_SCHEMA_VERSION"),
        _when(~top["audit_fingerprint"].rlike("^[a-f0-9]{64}$"), "INVALID_FINGERPRINT"),
        _fields("evaluation_scope", ["purpose", "analysis_type", "target_decision"], filled=True),
        _fields("dataset", ["dataset_name", "raw_observation_unit", "total_records", "entity_count"]),
        _when(F.coalesce(number("dataset", "total_records"), F.lit(0.0)) < 1, "TOTAL_RECORDS_BELOW_ONE"),
        _when(F.coalesce(number("dataset", "entity_count"), F.lit(0.0)) < 1, "ENTITY_COUNT_BELOW_ONE"),
        _when(F.col("sensitive_attributes").isNull(), "NOT_A_LIST:sensitive_attributes"),
        F.coalesce(F.flatten(F.transform("sensitive_attributes", attribute)), F.array().cast("array<string>")),
        _fields("evaluation_unit_alignment",
                ["evaluation_unit_level", "aggregation_strategy", "unit_key", "divergence_from_row_level"]),
        _fields("global_performance", ["accuracy", "balanced_accuracy"]),
        _fields("fairness_metrics",
                ["demographic_parity_difference", "equalized_odds_difference", "disparate_impact_ratio"]),
        _fields("policy_compliance", ["policy_name", "policy_type", "evidence_state", "policy_passed"]),
        _when(~F.coalesce(F.col("policy_compliance")["policy_type"], F.lit("")).isin(POLICY_TYPES), "INVALID_POLICY_TYPE"),
        _fields("privacy_governance", ["reporting_privacy_mode", "suppression_applied", "disclaimer"]),
        _when(
            ~(F.contains(disclaimer, F.lit("differential privacy")) & F.contains(disclaimer, F.lit("report privacy"))),
            "PRIVACY_DISCLAIMER_UNCLEAR",
        ),
        *[
            _when(tax.isNotNull() & ~F.coalesce(tax[f], F.lit("")).isin(values), f"INVALID_TAXONOMY:{f}")
            for f, values in allowed.items()
        ],
        _when(
            rev.isNotNull() & ~F.coalesce(rev["human_review_required"], F.lit("")).isin("true", "false"),
            "INVALID_REVIEW_FLAG",
        ),
        _when(rev.isNotNull() & ~F.startswith(F.coalesce(rev["reason_codes"], F.lit("")), F.lit("[")), "INVALID_REVIEW_CODES"),
    )
    return F.when(F.size(missing) > 0, missing).otherwise(rest)


SUBGROUP = (
    "struct<sample_size:double,positive_count:double,negative_count:double,selection_rate:double,accuracy:double,"
    "balanced_accuracy:double,TP:double,TN:double,FP:double,FN:double,TPR:double,TNR:double,FPR:double,FNR:double,PPV:double>"
)
GLOBAL = (
    "struct<demographic_parity_difference:double,equal_opportunity_difference:double,"
    "equalized_odds_difference:double,disparate_impact_ratio:double>"
)


def subgroup_errors(name: Column, s: Column, tol: float = TOLERANCE) -> Column:
    """Count and rate identities of one subgroup."""
    n = F.coalesce(s["sample_size"], F.lit(0.0))
    tp, tn, fp, fn = s["TP"], s["TN"], s["FP"], s["FN"]
    full = tp.isNotNull() & tn.isNotNull() & fp.isNotNull() & fn.isNotNull()
    tag = lambda code: F.concat(F.lit(f"{code}:"), name)
    count, rate = "INVALID_COUNT_IDENTITY", "INVALID_METRIC_IDENTITY"

    def off(observed: Column, num: Column, den: Column) -> Column:
        return full & (den > 0) & (F.abs(observed - F.try_divide(num, den)) > tol)

    return F.concat(
        _when(s["positive_count"] + s["negative_count"] != n, tag(count)),
        _when((n > 0) & (F.abs(s["accuracy"] - F.try_divide(tp + tn, n)) > tol), tag(rate)),
        _when(full & (tp + tn + fp + fn != n), tag(count)),
        _when(off(s["PPV"], tp, tp + fp), tag(rate)),
        _when(off(s["TPR"], tp, tp + fn), tag(rate)),
        _when(off(s["TNR"], tn, tn + fp), tag(rate)),
        _when(full & (F.abs(s["balanced_accuracy"] - (s["TPR"] + s["TNR"]) / 2.0) > tol), tag(rate)),
    )


def invariant_errors(dataset: Column, subgroups: Column, overall: Column, unit: Column, tol: float = TOLERANCE) -> Column:
    """All invariants of a document: dataset counts, subgroup identities, disparities against
    subgroup extrema, unit alignment, estimand.

    ``subgroups`` is a map to :data:`SUBGROUP`, ``overall`` a :data:`GLOBAL` struct; dataset
    and unit are text maps.
    """
    entries = F.coalesce(F.map_values(subgroups), F.array().cast(f"array<{SUBGROUP}>"))

    def extent(f: str) -> tuple[Column, Column, Column]:
        v = F.filter(F.transform(entries, lambda s: s[f]), lambda x: x.isNotNull() & ~F.isnan(x))
        return F.array_max(v), F.array_min(v), F.size(v)

    sel_hi, sel_lo, sel_n = extent("selection_rate")
    tpr_hi, tpr_lo, tpr_n = extent("TPR")
    fpr_hi, fpr_lo, fpr_n = extent("FPR")
    records, entities = (dataset[f].cast("double") for f in ("total_records", "entity_count"))
    rate = "INVALID_METRIC_IDENTITY"
    estimand = F.from_json(unit["statistical_estimand"], TEXT_MAP)
    obs_unit, dec_unit = unit["observational_record_unit"], unit["evaluation_decision_unit"]
    return F.concat(
        _when((records < 1) | (entities < 1), "INVALID_COUNT_IDENTITY:dataset"),
        _when(entities > records, "INVALID_COUNT_IDENTITY:entity_count"),
        F.coalesce(
            F.flatten(
                F.transform(F.map_entries(subgroups), lambda e: subgroup_errors(e["key"], e["value"], tol))
            ),
            F.array().cast("array<string>"),
        ),
        _when((sel_n >= 2) & (F.abs(overall["demographic_parity_difference"] - (sel_hi - sel_lo)) > tol),
              f"{rate}:demographic_parity_difference"),
        _when((tpr_n >= 2) & (F.abs(overall["equal_opportunity_difference"] - (tpr_hi - tpr_lo)) > tol),
              f"{rate}:equal_opportunity_difference"),
        _when(
            (tpr_n >= 2) & (fpr_n >= 2)
            & (F.abs(overall["equalized_odds_difference"] - F.greatest(tpr_hi - tpr_lo, fpr_hi - fpr_lo)) > tol),
            f"{rate}:equalized_odds_difference",
        ),
        _when((sel_n >= 2) & (sel_hi > 0) & (F.abs(overall["disparate_impact_ratio"] - F.try_divide(sel_lo, sel_hi)) > tol),
              f"{rate}:disparate_impact_ratio"),
        _when((obs_unit != dec_unit) & (unit["aggregation_strategy"] == "NONE"), "INVALID_UNIT_ALIGNMENT"),
        _when(
            (unit["bootstrap_resampling_unit"] == "ROW_LEVEL") & obs_unit.isin("TRIP_LEVEL", "ENTITY_LEVEL"),
            "INVALID_BOOTSTRAP_CONFIGURATION",
        ),
        _when(
            estimand.isNotNull() & ~F.coalesce(estimand["estimand_status"], F.lit("")).isin(ESTIMAND_STATUSES),
            "MISSING_ESTIMAND",
        ),
    )


def validate_documents(df: DataFrame, key: str = "run", document: str = "document") -> DataFrame:
    """One row per broken rule: structure first, identities for documents with all sections.

    Disparities are checked where documents keep them (fairness section) and fall back to the
    performance section of older ones.
    """
    parsed = with_sections(df, document)
    top = F.col("top")
    subgroups = F.from_json(top["subgroup_evaluations"], f"map<string,{SUBGROUP}>")
    fair = F.from_json(top["fairness_metrics"], GLOBAL)
    perf = F.from_json(top["global_performance"], GLOBAL)
    names = [f.split(":")[0] for f in GLOBAL[7:-1].split(",")]
    overall = F.struct(*[F.coalesce(fair[n], perf[n]).alias(n) for n in names])
    checked = parsed.select(
        key,
        structure_errors().alias("structure"),
        F.col("dataset"),
        F.col("evaluation_unit_alignment"),
        subgroups.alias("subgroups"),
        overall.alias("overall"),
    )
    identities = invariant_errors(
        F.col("dataset"), F.col("subgroups"), F.col("overall"), F.col("evaluation_unit_alignment")
    )
    absent = F.exists("structure", lambda e: F.startswith(e, F.lit("MISSING_SECTION")))
    errors = F.when(absent, F.col("structure")).otherwise(F.concat("structure", identities))
    return checked.select(key, F.explode(errors).alias("error"))


# --- evaluation manifest ------------------------------------------------------------------------------

def evaluation_manifests(
    decided: DataFrame,
    settings: dict[str, Column],
    key: str = "run",
    evaluation_id: Column | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """``run, evaluation_id, timestamp_utc, fingerprint, manifest``.

    ``settings`` are the material facts (data identity, features, split, seeds, model, policy).
    The fingerprint covers them only: ids and times may change without changing it, and unset
    facts leave no trace.
    """
    canonical = F.to_json(_sorted_struct(settings))
    return decided.select(
        F.col(key).alias("run"),
        (evaluation_id if evaluation_id is not None else F.uuid()).alias("evaluation_id"),
        (timestamp if timestamp is not None else F.current_timestamp()).cast("string").alias("timestamp_utc"),
        F.sha2(canonical, 256).alias("fingerprint"),
        canonical.alias("manifest"),
    )


