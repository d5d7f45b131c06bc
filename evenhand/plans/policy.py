"""Policy decisions on suite rows.

A policy is a row of thresholds. Every check becomes a struct in an array column, so any
number of runs times policies is decided in one map-only step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import vocab as V
from evenhand.session import stored

CHECK = (
    "struct<rule:string,metric:string,subgroup:string,observed:double,observed_text:string,threshold:double,"
    "operator:string,condition_status:string,reason_code:string,effect:string,fairness:boolean>"
)


@dataclass(frozen=True)
class Policy:
    """Thresholds; None switches a check off."""

    name: str = "Standard_Operational_Policy"
    policy_id: str = "POL-STD-2026.1"
    policy_version: str | None = "1.0.0"
    policy_type: str = "ANALYTICAL"
    effective_date: str = "2026-09-08"
    max_equalized_odds: float | None = 0.10
    max_demographic_parity: float | None = 0.10
    max_predictive_parity: float | None = None
    min_disparate_impact: float | None = 0.80
    min_balanced_accuracy: float = 0.60
    min_recall: float | None = 0.10
    min_specificity: float | None = 0.10
    min_precision: float | None = None
    min_subgroup_balanced_accuracy: float | None = None
    min_subgroup_recall: float | None = None
    min_subgroup_specificity: float | None = None
    require_better_than_majority: bool = True
    require_subgroup_support: bool = False
    critical_subgroups: Sequence[str] = ()
    #: predictive parity and precision limits are part of a policy but are not
    #: checked unless asked for
    check_declared_limits: bool = False


def default_policies() -> list[Policy]:
    """The three policies of a sensitivity run."""
    return [
        Policy("Standard_Operational_Policy", "POL-STD-2026.1", min_balanced_accuracy=0.55),
        Policy(
            "Strict_Equalized_Odds_Policy", "POL-STRICT-EO-2026.1", min_balanced_accuracy=0.60,
            max_equalized_odds=0.05, min_disparate_impact=0.85, min_recall=0.50,
        ),
        Policy(
            "Lenient_Diagnostic_Policy", "POL-LENIENT-2026.1", min_balanced_accuracy=0.52,
            max_equalized_odds=0.15, min_disparate_impact=0.70,
        ),
    ]


def _policy_struct(p: Policy) -> Column:
    def num(x, name):
        return F.lit(x).cast("double").alias(name)

    return F.struct(
        F.lit(p.name).alias("name"),
        F.lit(p.policy_id).alias("policy_id"),
        F.lit(p.policy_version).cast("string").alias("policy_version"),
        F.lit(p.policy_type).alias("policy_type"),
        F.lit(p.effective_date).alias("effective_date"),
        num(p.max_equalized_odds, "max_equalized_odds"),
        num(p.max_demographic_parity, "max_demographic_parity"),
        num(p.max_predictive_parity, "max_predictive_parity"),
        num(p.min_disparate_impact, "min_disparate_impact"),
        num(p.min_balanced_accuracy, "min_balanced_accuracy"),
        num(p.min_recall, "min_recall"),
        num(p.min_specificity, "min_specificity"),
        num(p.min_precision, "min_precision"),
        num(p.min_subgroup_balanced_accuracy, "min_subgroup_balanced_accuracy"),
        num(p.min_subgroup_recall, "min_subgroup_recall"),
        num(p.min_subgroup_specificity, "min_subgroup_specificity"),
        F.lit(p.require_better_than_majority).alias("require_better_than_majority"),
        F.lit(p.require_subgroup_support).alias("require_subgroup_support"),
        F.array(*[F.lit(c) for c in p.critical_subgroups]).cast("array<string>").alias("critical_subgroups"),
        F.lit(p.check_declared_limits).alias("check_declared_limits"),
    )


def _check(
    rule: str,
    status: str,
    code: str,
    effect: str,
    metric: str | None = None,
    subgroup: str = "NULL",
    observed: str = "NULL",
    observed_text: str = "NULL",
    threshold: str = "NULL",
    operator: str | None = None,
    fairness: bool = False,
) -> str:
    """One check as SQL text; the value arguments are SQL expressions."""

    def word(x: str | None) -> str:
        return "CAST(NULL AS string)" if x is None else f"'{x}'"

    fields = {
        "rule": word(rule),
        "metric": word(metric),
        "subgroup": f"CAST({subgroup} AS string)",
        "observed": f"CAST({observed} AS double)",
        "observed_text": f"CAST({observed_text} AS string)",
        "threshold": f"CAST({threshold} AS double)",
        "operator": word(operator),
        "condition_status": word(status),
        "reason_code": word(code),
        "effect": word(effect),
        "fairness": "true" if fairness else "false",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


NONE = f"CAST(array() AS array<{CHECK}>)"
PASSED, FAILED, OPEN = "PASSED", "FAILED", "INSUFFICIENT_EVIDENCE"


def _cases(*branches: tuple[str, str], otherwise: str | None = None) -> str:
    """First check whose condition holds, as a list of at most one."""
    whens = " ".join(f"WHEN {cond} THEN array({check})" for cond, check in branches)
    return f"CASE {whens} ELSE {f'array({otherwise})' if otherwise else NONE} END"


def _ceiling(short: str, metric: str, limit: str, prefix: str, active: str = "true") -> str:
    """Upper limit on a gap; an undefined gap counts as a violation without evidence."""
    value, status = f"{short}_value", f"{short}_status"
    common = dict(metric=metric, observed=value, threshold=limit, operator="<=", fairness=True)
    inner = _cases(
        (f"{status} <> '{V.VALID}'", _check("disparity", OPEN, f"{prefix}_UNDEFINED", "violation", observed_text=status, **common)),
        (f"{value} > {limit}", _check("disparity", FAILED, f"{prefix}_THRESHOLD_EXCEEDED", "violation", **common)),
        otherwise=_check("disparity", PASSED, f"{prefix}_SATISFIED", "pass", **common),
    )
    return f"IF({active} AND {limit} IS NOT NULL, {inner}, {NONE})"


def _floor(metric: str, value: str, limit: str, code: str, active: str = "true") -> str:
    common = dict(metric=metric, observed=value, threshold=limit, operator=">=")
    inner = _cases(
        (f"{value} < {limit}", _check("utility", FAILED, code, "violation", **common)),
        otherwise=_check("utility", PASSED, code.replace("BELOW_MINIMUM", "SATISFIED"), "pass", **common),
    )
    return f"IF({active} AND {limit} IS NOT NULL AND {value} IS NOT NULL, {inner}, {NONE})"


def _subgroup_floor(field: str, metric: str, limit: str, code: str) -> str:
    low = _check("subgroup_floor", FAILED, code, "violation", metric=metric, subgroup="g.grp", observed=f"g.{field}",
                 threshold=limit, operator=">=")
    return f"coalesce(transform(filter(subgroups, g -> g.{field} < {limit}), g -> {low}), {NONE})"


def _critical_checks() -> str:
    """Every required label: seen, supported, and not too far from the best TPR."""
    gap = "(array_max(transform(subgroups, x -> x.tpr)) - g.tpr)"
    absent = _check("critical_subgroup_support", OPEN, "CRITICAL_SUBGROUP_UNOBSERVED", "abstention", subgroup="c")
    thin = _check("critical_subgroup_support", OPEN, "CRITICAL_SUBGROUP_INSUFFICIENT_SUPPORT", "abstention", subgroup="c",
                  observed_text="g.support_status")
    apart = _check("critical_subgroup_disparity", FAILED, "CRITICAL_SUBGROUP_DISPARITY_VIOLATION", "violation", subgroup="c",
                   observed=gap, threshold="policy.max_equalized_odds")
    seen = (
        f"flatten(transform(filter(subgroups, g -> g.grp = c), g -> concat("
        f"{_cases((f'g.support_status <> {chr(39)}{V.VALID}{chr(39)}', thin))}, "
        f"{_cases((f'{gap} > policy.max_equalized_odds', apart))})))"
    )
    per = f"concat(IF(exists(subgroups, g -> g.grp = c), {NONE}, array({absent})), {seen})"
    return f"IF(size(subgroups) > 0, flatten(transform(policy.critical_subgroups, c -> {per})), {NONE})"


def _interval_checks() -> list[str]:
    parts = []
    for metric in (V.EODDS, V.DP, V.DIR):
        status = f"intervals['{metric}'].support_status"
        check = _check("bootstrap_uncertainty_support", OPEN, "INSUFFICIENT_BOOTSTRAP_SUPPORT", "abstention", metric=metric,
                       observed_text=status)
        parts.append(_cases((f"{status} = '{V.INSUFFICIENT_BOOTSTRAP}'", check)))
    return parts


def _among(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _support_checks() -> str:
    return (
        f"IF(policy.require_subgroup_support, transform(filter(subgroups, g -> g.support_status = '{V.INSUFFICIENT_GROUP}'), g -> "
        + _check("subgroup_support", OPEN, "SUBGROUP_INSUFFICIENT_SUPPORT", "abstention", subgroup="g.grp")
        + f"), {NONE})"
    )


def _floor_checks() -> list[str]:
    return [
        _subgroup_floor("balanced_accuracy", "Balanced Accuracy", "policy.min_subgroup_balanced_accuracy",
                        "SUBGROUP_BALANCED_ACCURACY_BELOW_MINIMUM"),
        _subgroup_floor("tpr", "TPR", "policy.min_subgroup_recall", "SUBGROUP_RECALL_BELOW_MINIMUM"),
        _subgroup_floor("tnr", "TNR", "policy.min_subgroup_specificity", "SUBGROUP_SPECIFICITY_BELOW_MINIMUM"),
    ]


def policy_checks(columns: Sequence[str], lists: bool = True) -> Column:
    """All checks of the ``policy`` struct in their fixed order, as one SQL expression; without ``lists``, those
    that look at single groups are left out."""
    degenerate = f"degeneracy_status <> '{V.NORMAL}'"
    absent_group = _among("overall_status", [V.MISSING_VIOLATION, V.MISSING_SENSITIVE])
    thin = _among(
        "overall_status",
        [V.INSUFFICIENT_GROUP, V.UNRELIABLE, V.INSUFFICIENT_BOOTSTRAP, V.INSUFFICIENT_CALIBRATION, V.UNDEFINED],
    )
    unstable = f"di_status = '{V.UNSTABLE_RATIO}'"
    declared = "policy.check_declared_limits"
    deg = dict(metric="model_degeneracy_status", observed_text="degeneracy_status")
    st = dict(metric="overall_status", observed_text="overall_status")
    bal = dict(metric="Balanced Accuracy", observed="balanced_accuracy", threshold="policy.min_balanced_accuracy", operator=">=")
    di = dict(metric=V.DIR, observed="di_value", threshold="policy.min_disparate_impact", operator=">=", fairness=True)
    parts = [
        _cases(
            (degenerate, _check("anti_degeneracy", FAILED, "MODEL_DEGENERATE", "violation", **deg)),
            otherwise=_check("anti_degeneracy", PASSED, "MODEL_NORMAL", "pass", **deg),
        ),
        _cases(
            (absent_group, _check("missing_sensitive_attributes", OPEN, "MISSING_SENSITIVE_ATTRIBUTE", "abstention", **st)),
            (thin, _check("evaluation_status_integrity", OPEN, "STATUS_INSUFFICIENT_EVIDENCE", "abstention", **st)),
            otherwise=_check("evaluation_status_integrity", PASSED, "STATUS_VALID", "pass", **st),
        ),
        *([_critical_checks(), _support_checks()] if lists else []),
        *(_interval_checks() if "intervals" in columns else []),
        _cases((unstable, _check("ratio_metric_stability", OPEN, "UNSTABLE_RATIO_DENOMINATOR", "abstention", metric=V.DIR))),
        _cases(
            ("balanced_accuracy < policy.min_balanced_accuracy",
             _check("utility", FAILED, "BALANCED_ACCURACY_BELOW_MINIMUM", "violation", **bal)),
            otherwise=_check("utility", PASSED, "BALANCED_ACCURACY_SATISFIED", "pass", **bal),
        ),
    ]
    if "majority_balanced_accuracy" in columns:
        parts.append(
            _cases(
                ("policy.require_better_than_majority AND balanced_accuracy <= majority_balanced_accuracy",
                 _check("majority_baseline", FAILED, "BELOW_MAJORITY_BASELINE", "violation", metric="Balanced Accuracy",
                        observed="balanced_accuracy", threshold="majority_balanced_accuracy", operator=">")),
            )
        )
    parts += [
        _floor("Recall", "recall", "policy.min_recall", "RECALL_BELOW_MINIMUM"),
        _floor("TNR", "specificity", "policy.min_specificity", "SPECIFICITY_BELOW_MINIMUM"),
        _floor("Precision", "precision", "policy.min_precision", "PRECISION_BELOW_MINIMUM", declared),
        *(_floor_checks() if lists else []),
        _ceiling("eodds", V.EODDS, "policy.max_equalized_odds", "EO_DIFF"),
        _ceiling("dp", V.DP, "policy.max_demographic_parity", "DP_DIFF"),
        _ceiling("pp", V.PP, "policy.max_predictive_parity", "PP_DIFF", declared),
        "IF(policy.min_disparate_impact IS NULL, " + NONE + ", "
        + _cases(
            (f"di_status = '{V.VALID}' AND di_value < policy.min_disparate_impact",
             _check("disparity", FAILED, "DIR_THRESHOLD_VIOLATION", "violation", **di)),
            (f"di_status = '{V.VALID}'", _check("disparity", PASSED, "DIR_SATISFIED", "pass", **di)),
            (unstable, _check("disparity", FAILED, "DIR_UNSTABLE_RATIO", "violation", **di)),
        )
        + ")",
        _cases(
            ("trim(coalesce(policy.policy_version, '')) IN ('', 'None')",
             _check("policy_version", OPEN, "GATE_UNIDENTIFIED_POLICY_VERSION", "abstention")),
        ),
    ]
    if "estimand_status" in columns:
        parts.append(
            _cases(
                ("estimand_status IN ('ESTIMAND_UNSPECIFIED', 'UNSPECIFIED')",
                 _check("estimand", OPEN, "GATE_ESTIMAND_UNSPECIFIED", "abstention")),
            )
        )
    return F.expr(f"CAST(concat({', '.join(parts)}) AS array<{CHECK}>)")


def decide(suites: DataFrame, policies: Sequence[Policy] | None = None) -> DataFrame:
    """Suite rows with policy, ordered evidence trace, reason codes and decision."""
    return _verdicts(_checked(suites, policies)).drop("__codes")


def _checked(suites: DataFrame, policies: Sequence[Policy] | None, lists: bool = True) -> DataFrame:
    """Suite rows with policy and checks, what they count to, and the codes of those that did not pass."""
    policies = list(policies) if policies is not None else default_policies()
    frame = suites.withColumn("policy", F.explode(F.array(*[_policy_struct(p) for p in policies])))
    frame = frame.withColumn("checks", policy_checks(frame.columns, lists))
    count = lambda effect: F.size(F.filter("checks", lambda c: c["effect"] == effect))
    return frame.withColumns(
        {
            "__codes": F.transform(F.filter("checks", lambda c: c["effect"] != "pass"), lambda c: c["reason_code"]),
            "violation_count": count("violation"),
            "abstention_count": count("abstention"),
            "is_fair": ~F.exists("checks", lambda c: c["fairness"] & (c["effect"] == "violation")),
        }
    )


def _verdicts(frame: DataFrame) -> DataFrame:
    """Decision, codes and evidence states from the counts."""
    degenerate = F.col("degeneracy_status") != V.NORMAL
    d = (
        F.when(degenerate, "POLICY_DEGENERATE")
        .when(F.col("abstention_count") > 0, "POLICY_UNDEFINED")
        .when(F.col("violation_count") > 0, "POLICY_NONCOMPLIANT")
        .otherwise("POLICY_COMPLIANT")
    )

    def lacks(*words: str) -> Column:
        return ~F.exists("__codes", lambda c: c.rlike("|".join(words)))

    frame = frame.withColumns(
        {
            "decision": d,
            "is_degenerate": degenerate,
            "is_useful": ~degenerate
            & F.coalesce(F.col("balanced_accuracy") >= F.col("policy.min_balanced_accuracy"), F.lit(False)),
        }
    )
    d = F.col("decision")
    final_codes = (
        F.when(
            (d == "POLICY_UNDEFINED") & lacks("INSUFFICIENT", "MISSING", "UNSTABLE"),
            F.concat(F.array(F.lit("INSUFFICIENT_EVIDENCE_ABSTENTION")), "__codes"),
        )
        .when(
            (d == "POLICY_NONCOMPLIANT") & lacks("THRESHOLD", "VIOLATION", "BELOW"),
            F.concat(F.array(F.lit("POLICY_THRESHOLD_VIOLATION")), "__codes"),
        )
        .when(d == "POLICY_COMPLIANT", F.concat("__codes", F.array(F.lit("ALL_POLICY_RULES_SATISFIED"))))
        .otherwise(F.col("__codes"))
    )
    return frame.withColumns(
        {
            "reason_codes": final_codes,
            "policy_passed": d == "POLICY_COMPLIANT",
            "evidence_state": F.when(d == "POLICY_COMPLIANT", "PASS")
            .when(d == "POLICY_UNDEFINED", "INSUFFICIENT_EVIDENCE")
            .otherwise("FAIL"),
            "evidence_strength": F.when(d == "POLICY_DEGENERATE", "DEGENERATE_PREDICTOR")
            .when(d == "POLICY_UNDEFINED", "INSUFFICIENT_EVIDENCE")
            .when(d == "POLICY_NONCOMPLIANT", "POLICY_CONSTRAINTS_VIOLATED")
            .otherwise("CONFIRMED_ADEQUATE"),
        }
    )


def subgroup_evidence(subgroups: DataFrame, policies: Sequence[Policy], by: Sequence[str] = ("run",)) -> DataFrame:
    """``by..., policy_name, rule, ...``: a row for each check of a group that did not pass.

    Floors and support are checks of one group's row. Labels that a policy names are few; they meet with the group of the
    best TPR of their run in a short list.
    """
    by, rules = list(by), F.explode(F.array(*[_policy_struct(p) for p in policies]))
    names = [c for c in subgroups.columns if c not in by]
    group = F.struct(*names)
    single = subgroups.select(*by, F.array(group).alias("subgroups")).withColumn("policy", rules)
    checks = F.expr(f"CAST(concat({', '.join([_support_checks(), *_floor_checks()])}) AS array<{CHECK}>)")
    found = single.select(*by, F.col("policy.name").alias("policy_name"), F.explode(checks).alias("c"))
    critical = sorted({c for p in policies for c in p.critical_subgroups})
    if critical:
        named = F.collect_list(F.when(F.col("grp").isin(*critical), group))  # as many as the policies name
        per = subgroups.groupBy(*by).agg(named.alias("named"), F.max_by(group, "tpr").alias("best"))
        both = F.filter(F.array_union("named", F.array("best")), lambda g: g.isNotNull())
        few = per.select(*by, both.alias("subgroups")).withColumn("policy", rules)
        # the list is never empty where a run has groups, even if all their rates are undefined
        few = few.withColumn("subgroups", F.when(F.size("subgroups") > 0, F.col("subgroups")).otherwise(F.array(F.lit(None).cast(few.schema["subgroups"].dataType.elementType))))
        found = found.unionByName(
            few.select(*by, F.col("policy.name").alias("policy_name"), F.explode(F.expr(f"CAST({_critical_checks()} AS array<{CHECK}>)")).alias("c"))
        )
    return found.select(*by, "policy_name", "c.*")


def decide_long(
    suites: DataFrame, subgroups: DataFrame, policies: Sequence[Policy] | None = None, by: Sequence[str] = ("run",)
) -> tuple[DataFrame, DataFrame]:
    """:func:`decide` on suite rows without lists: decisions, and the evidence of groups as rows.

    Decisions and counts are those of :func:`decide`; ``checks`` has those of the whole run only, and ``reason_codes``
    each code of a group once.
    """
    by, policies = list(by), list(policies) if policies is not None else default_policies()
    evidence = stored(subgroup_evidence(subgroups, policies, by))
    folded = evidence.groupBy(*by, "policy_name").agg(
        F.count(F.when(F.col("effect") == "violation", 1)).alias("__v"), F.count(F.when(F.col("effect") == "abstention", 1)).alias("__a"),
        F.sort_array(F.collect_set("reason_code")).alias("__more"),  # the codes that there are
    )
    run = _checked(suites, policies, lists=False).withColumn("policy_name", F.col("policy.name"))
    both = run.join(folded, [*by, "policy_name"], "left")
    both = both.withColumns(
        {
            "violation_count": F.col("violation_count") + F.coalesce("__v", F.lit(0)),
            "abstention_count": F.col("abstention_count") + F.coalesce("__a", F.lit(0)),
            "__codes": F.concat("__codes", F.coalesce("__more", F.array().cast("array<string>"))),
        }
    )
    return _verdicts(both).drop("__codes", "__v", "__a", "__more"), evidence


def trace_rows(decided: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """One row per check, in order."""
    return decided.select(
        *by, F.col("policy.name").alias("policy_name"), F.posexplode("checks").alias("step", "c")
    ).select(*by, "policy_name", "step", "c.*")


# --- decision gate ----------------------------------------------------------------------------------

def decision_gate(
    decided: DataFrame,
    estimand_status: Column | None = None,
    unit_valid: Column | None = None,
    split_valid: Column | None = None,
    leakage_findings: Column | None = None,
    invariants_valid: Column | None = None,
) -> DataFrame:
    """Nine prerequisites of a confirmatory decision. A failed gate makes the decision
    undefined and appends its codes."""
    estimand = estimand_status if estimand_status is not None else F.lit(None).cast("string")
    true = F.lit(True)
    codes = F.concat(
        _code(estimand.isNull(), "GATE_MISSING_ESTIMAND"),
        _code(estimand.isin("ESTIMAND_UNSPECIFIED", "UNSPECIFIED"), "GATE_ESTIMAND_UNSPECIFIED"),
        _code(~(unit_valid if unit_valid is not None else true), "GATE_INVALID_EVALUATION_UNIT"),
        _code(~(split_valid if split_valid is not None else true), "GATE_INVALID_SPLIT"),
        _code((leakage_findings if leakage_findings is not None else F.lit(0)) > 0, "GATE_LEAKAGE_DETECTED"),
        F.transform(
            F.filter("subgroups", lambda g: g["support_status"] == V.INSUFFICIENT_GROUP),
            lambda g: F.lit("GATE_INSUFFICIENT_SUBGROUP_SUPPORT"),
        ),
        (
            F.transform(
                F.filter(F.map_values("intervals"), lambda i: i["valid_fraction"] < 0.80),
                lambda i: F.lit("GATE_INVALID_UNCERTAINTY"),
            )
            if "intervals" in decided.columns
            else F.array().cast("array<string>")
        ),
        _code(~(invariants_valid if invariants_valid is not None else true), "GATE_INVARIANT_VIOLATION"),
        _code(F.size("checks") == 0, "GATE_INCOMPLETE_EVIDENCE_TRACE"),
        _code(
            F.trim(F.coalesce(F.col("policy.policy_version"), F.lit(""))).isin("", "None"),
            "GATE_UNIDENTIFIED_POLICY_VERSION",
        ),
    )
    out = decided.withColumn("gate_codes", codes).withColumn("gate_passed", F.size("gate_codes") == 0)
    failed = ~F.col("gate_passed")
    return (
        out.withColumn("decision", F.when(failed, "POLICY_UNDEFINED").otherwise(F.col("decision")))
        .withColumn("evidence_state", F.when(failed, "INSUFFICIENT_EVIDENCE").otherwise(F.col("evidence_state")))
        .withColumn("policy_passed", F.col("policy_passed") & F.col("gate_passed"))
        .withColumn("reason_codes", F.when(failed, F.concat("reason_codes", "gate_codes")).otherwise(F.col("reason_codes")))
    )


def _code(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))


# --- taxonomy, review, success ------------------------------------------------------------------------

def taxonomy(
    decided: DataFrame,
    execution: Column | None = None,
    leakage_findings: Column | None = None,
    analysis_type: Column | None = None,
    gate_passed: Column | None = None,
) -> DataFrame:
    """Decoupled statuses with five precedences, as a struct column ``taxonomy``."""
    execution = execution if execution is not None else F.lit("COMPLETE")
    leaks = leakage_findings if leakage_findings is not None else F.lit(0)
    analysis = analysis_type if analysis_type is not None else F.lit("CONFIRMATORY_ANALYSIS")
    gate = gate_passed if gate_passed is not None else F.lit(None).cast("boolean")
    confirmatory = analysis.isin(V.CONFIRMATORY)
    model = F.when(leaks > 0, "INVALID").when(F.col("degeneracy_status") == V.DEGENERATE, "DEGENERATE").otherwise("ACCEPTABLE")
    thin_group = F.exists("subgroups", lambda g: g["support_status"] == V.INSUFFICIENT_GROUP)
    thin_interval = (
        F.coalesce(F.exists(F.map_values("intervals"), lambda i: i["valid_fraction"] < 0.80), F.lit(False))
        if "intervals" in decided.columns
        else F.lit(False)
    )
    evidence = F.when((model == "DEGENERATE") | thin_group | thin_interval, "INSUFFICIENT").otherwise("SUFFICIENT")
    rule = (
        F.when(execution == "BLOCKED", "PRECEDENCE_EXECUTION_BLOCKED")
        .when(model == "INVALID", "PRECEDENCE_MODEL_INVALID")
        .when(model == "DEGENERATE", "PRECEDENCE_MODEL_DEGENERATE")
        .when((evidence == "INSUFFICIENT") & confirmatory, "PRECEDENCE_EVIDENCE_INSUFFICIENT")
        .when((F.coalesce(gate, F.lit(True)) == F.lit(False)) & confirmatory, "PRECEDENCE_CONFIRMATORY_REQUIREMENTS_UNMET")
    )
    policy = (
        F.when(rule == "PRECEDENCE_MODEL_DEGENERATE", "FAIL")
        .when(rule.isNotNull(), "NOT_EVALUABLE")
        .when(F.col("policy_passed"), "PASS")
        .otherwise("FAIL")
    )
    forced = rule.isin("PRECEDENCE_EXECUTION_BLOCKED", "PRECEDENCE_MODEL_INVALID", "PRECEDENCE_MODEL_DEGENERATE")
    return decided.withColumn(
        "taxonomy",
        F.struct(
            execution.alias("audit_execution_status"),
            F.when(F.coalesce(forced, F.lit(False)), "INSUFFICIENT").otherwise(evidence).alias("evidence_status"),
            model.alias("model_status"),
            policy.alias("policy_status"),
            rule.alias("precedence_rule_applied"),
            (~confirmatory).alias("is_exploratory"),
        ),
    )


#: Why a person should look, by code.
REVIEW_NOTES = {
    "REVIEW_MATERIAL_POLICY_VIOLATION": "A policy condition failed; a person decides before deployment.",
    "REVIEW_INCONCLUSIVE_EVIDENCE": "The evidence is thin or the policy could not be evaluated; a person decides what to gather.",
    "REVIEW_DERIVED_SENSITIVE_ATTRIBUTE": "The groups are derived or imputed; legal and demographic review.",
    "REVIEW_REGULATORY_MAPPING": "Thresholds come from a mapping of regulation; legal review.",
    "REVIEW_LOW_SUPPORT": "Groups below the support gate: ",
    "REVIEW_AMBIGUOUS_ESTIMAND": "What the figures estimate is not stated or not clear.",
    "REVIEW_FEATURE_TIMING": "Features go by time or order; check the cut-off at prediction time.",
    "REVIEW_UNIT_MISMATCH": "The decision unit is not the record; domain review.",
    "REVIEW_POLICY_AMBIGUITY": "Conditions of the policy are unclear or in conflict.",
}


def review_notes(codes: Column, thin: Column) -> Column:
    """A note for each code, in order; ``thin`` are the labels of groups below the gate."""
    lookup = F.create_map(*[F.lit(x) for kv in REVIEW_NOTES.items() for x in kv])
    named = F.concat(lookup["REVIEW_LOW_SUPPORT"], F.array_join(F.array_sort(thin), ", "))
    return F.transform(
        codes,
        lambda c: F.when(c == "REVIEW_LOW_SUPPORT", named).otherwise(F.coalesce(lookup[c], F.concat(F.lit("Asked for by the caller: "), c))),
    )


def review_codes(
    classified: DataFrame,
    lineage: Column | None = None,
    estimand_specified: Column | None = None,
    timing_features: Column | None = None,
    unit_mismatch: Column | None = None,
    policy_ambiguity: Column | None = None,
    additional: Sequence[str] = (),
) -> DataFrame:
    """Reasons for human review, with a note each, as a struct column ``review``; needs ``taxonomy``."""
    no = F.lit(False)
    lineage = lineage if lineage is not None else F.lit("OBSERVED")
    t = F.col("taxonomy")
    codes = F.concat(
        _code(t["policy_status"] == "FAIL", "REVIEW_MATERIAL_POLICY_VIOLATION"),
        _code(
            (t["policy_status"] == "NOT_EVALUABLE") | (t["evidence_status"] == "INSUFFICIENT"),
            "REVIEW_INCONCLUSIVE_EVIDENCE",
        ),
        _code(lineage.isin("DERIVED_PROXY", "IMPUTED"), "REVIEW_DERIVED_SENSITIVE_ATTRIBUTE"),
        _code(F.contains(F.upper(F.col("policy.policy_type")), F.lit("REGULATORY")), "REVIEW_REGULATORY_MAPPING"),
        _code(F.exists("subgroups", lambda g: g["support_status"] == V.INSUFFICIENT_GROUP), "REVIEW_LOW_SUPPORT"),
        _code(~(estimand_specified if estimand_specified is not None else F.lit(True)), "REVIEW_AMBIGUOUS_ESTIMAND"),
        _code(timing_features if timing_features is not None else no, "REVIEW_FEATURE_TIMING"),
        _code(unit_mismatch if unit_mismatch is not None else no, "REVIEW_UNIT_MISMATCH"),
        _code(policy_ambiguity if policy_ambiguity is not None else no, "REVIEW_POLICY_AMBIGUITY"),
    )
    if additional:
        extra = [V.REVIEW_ALIASES.get(a, a) for a in additional]
        codes = F.array_union(codes, F.array(*[F.lit(e) for e in extra]))
    thin = F.transform(F.filter("subgroups", lambda g: g["support_status"] == V.INSUFFICIENT_GROUP), lambda g: g["grp"])
    return classified.withColumn(
        "review",
        F.struct((F.size(codes) > 0).alias("human_review_required"), codes.alias("reason_codes"), review_notes(codes, thin).alias("notes")),
    )


def success_class(min_balanced: Column, max_odds: Column, max_parity: float = 0.10) -> Column:
    """Fair or not, useful or degenerate; UNDEFINED unless the evaluation is valid."""
    odds = F.when(F.col("eodds_status") == V.VALID, F.col("eodds_value")).otherwise(0.0)
    parity = F.when(F.col("dp_status") == V.VALID, F.col("dp_value")).otherwise(0.0)
    fair = (odds <= max_odds) & (parity <= max_parity)
    useful = (F.col("degeneracy_status") == V.NORMAL) & F.coalesce(F.col("balanced_accuracy") >= min_balanced, F.lit(False))
    return (
        F.when(F.col("overall_status") != V.VALID, "UNDEFINED")
        .when(fair & useful, "FAIR_AND_USEFUL")
        .when(useful, "UNFAIR_AND_USEFUL")
        .when(fair, "FAIR_BUT_DEGENERATE")
        .otherwise("UNFAIR_AND_DEGENERATE")
    )


# --- required subgroups, report privacy -----------------------------------------------------------------

def required_subgroups(subgroups: DataFrame, required: DataFrame) -> DataFrame:
    """Each required label: observed and supported, unsupported, or not observed."""
    seen = subgroups.select("grp", "support_status")
    return required.join(seen, "grp", "left").select(
        "grp",
        F.when(F.col("support_status").isNull(), "CRITICAL_SUBGROUP_UNOBSERVED")
        .when(F.col("support_status") != V.VALID, "CRITICAL_SUBGROUP_INSUFFICIENT_SUPPORT")
        .otherwise("SUPPORTED")
        .alias("finding"),
    )


def govern_report(
    suites: DataFrame,
    mode: str = "FULL_INTERNAL",
    min_population: int = 10,
    max_groups: int | None = None,
    mask_labels: bool = False,
) -> DataFrame:
    """Subgroup list fit for the audience, with a record of what was held back."""
    total = F.size("subgroups")
    if mode == "FULL_INTERNAL":
        shown, masked = F.col("subgroups"), F.lit(False)
    elif mode == "SUMMARY_ONLY":
        shown, masked = F.slice("subgroups", 1, 0), F.lit(False)
    elif mode == "REDACTED_EXTERNAL":
        by_size = F.array_sort(
            F.filter("subgroups", lambda g: g["n"] >= min_population),
            lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1))
            .when(a["grp"] < b["grp"], -1)
            .when(a["grp"] > b["grp"], 1)
            .otherwise(0),
        )
        shown = F.slice(by_size, 1, max_groups) if max_groups is not None else by_size
        if mask_labels:
            shown = F.transform(
                shown, lambda g, i: g.withField("grp", F.format_string("REDACTED_GROUP_%03d", i + 1))
            )
        masked = F.lit(mask_labels)
    else:
        raise ValueError(f"unknown report mode: {mode}")
    out = suites.withColumn("__shown", shown)
    held_back = total - F.size("__shown")
    applied = F.lit(mode == "SUMMARY_ONLY") | ((held_back > 0) | masked) if mode != "FULL_INTERNAL" else F.lit(False)
    return (
        out.withColumn(
            "privacy",
            F.struct(
                F.lit(mode).alias("privacy_mode"),
                applied.alias("suppression_applied"),
                F.lit(min_population).alias("min_reporting_population"),
                held_back.alias("suppressed_groups_count"),
                F.size("__shown").alias("disclosed_groups_count"),
                masked.alias("labels_masked"),
                F.lit(
                    "Report privacy by cell suppression and label masking; this is not differential privacy."
                ).alias("disclaimer"),
            ),
        )
        .withColumn("subgroups", F.col("__shown"))
        .drop("__shown")
    )
