"""Audit frames: role columns, predicates, missing-group policy, feature contract."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand import vocab as V
from evenhand.functions.expr import count_where, ratio
from evenhand.operators.order import attach, exact_quantiles


@dataclass(frozen=True)
class ColumnRoles:
    """Names of the columns that play a part in an audit."""

    target: str
    sensitive: Sequence[str]
    prediction: str | None = None
    score: str | None = None
    row_id: str | None = None
    grouping: str | None = None
    temporal: str | None = None
    unit_key: str | None = None
    cluster: str | None = None
    weight: str | None = None
    features: Sequence[str] = field(default_factory=tuple)

    def named(self) -> list[tuple[str, str]]:
        roles = [("target", self.target)]
        roles += [("sensitive", c) for c in self.sensitive]
        for role in ("prediction", "score", "row_id", "grouping", "temporal", "unit_key", "cluster", "weight"):
            name = getattr(self, role)
            if name:
                roles.append((role, name))
        roles += [("feature", c) for c in self.features]
        return roles


class MissingColumnsError(ValueError):
    """A role names a column the table does not have."""


class InvalidLabelsError(ValueError):
    """Labels or predictions that are not finite."""


def missing_columns(df: DataFrame, roles: ColumnRoles) -> list[str]:
    """One message per role whose column is absent (schema check, no scan)."""
    have = set(df.columns)
    return [f"{role} column '{name}' missing" for role, name in roles.named() if name not in have]


def feature_columns(df: DataFrame, roles: ColumnRoles) -> list[str]:
    """Named features, or every column without another role."""
    if roles.features:
        return list(roles.features)
    taken = {name for _, name in roles.named()}
    return [c for c in df.columns if c not in taken]


def group_label(columns: Sequence[str], separator: str = " x ") -> Column:
    """A composite group label. A missing attribute takes part as ``nan``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws(separator, *parts)


def audit_frame(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Rename role columns to the fixed audit names and keep the features.

    A single sensitive column keeps its NULLs (the missing-group policy decides about
    them); several are joined with ``_x_``.
    """
    problems = missing_columns(df, roles)
    if problems:
        raise MissingColumnsError("; ".join(problems))
    grp = (
        F.col(roles.sensitive[0]).cast("string")
        if len(roles.sensitive) == 1
        else group_label(roles.sensitive, "_x_")
    )
    out = [F.col(roles.target).cast("int").alias("y_true"), grp.alias("grp")]
    optional = {
        "y_pred": (roles.prediction, "int"),
        "y_prob": (roles.score, "double"),
        "row_id": (roles.row_id, None),
        "entity_id": (roles.unit_key, None),
        "cluster_id": (roles.cluster, None),
        "weight": (roles.weight, "double"),
        "ts": (roles.temporal, None),
        "holdout_key": (roles.grouping, None),
    }
    for alias, (name, kind) in optional.items():
        if name:
            out.append((F.col(name).cast(kind) if kind else F.col(name)).alias(alias))
    taken = {"y_true", "grp", *optional}
    out += [F.col(c) for c in feature_columns(df, roles) if c not in taken]
    return df.select(*out)


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        exprs.append(c)
    return df.select(*exprs)


def input_problems(df: DataFrame, labels: Sequence[str] = ("y_true", "y_pred")) -> DataFrame:
    """Non-finite and non-binary label counts, one row, one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in labels:
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        aggs.append(count_where(bad).alias(f"{c}_not_finite"))
        aggs.append(count_where(~bad & ~x.isin(0.0, 1.0)).alias(f"{c}_not_binary"))
    return df.agg(*aggs)


def require_clean_labels(df: DataFrame, labels: Sequence[str] = ("y_true", "y_pred")) -> None:
    row = input_problems(df, labels).first()
    bad = {c: row[f"{c}_not_finite"] for c in labels if row[f"{c}_not_finite"]}
    if bad:
        raise InvalidLabelsError(f"labels with missing or infinite values: {bad}")


def is_missing_group(group: str = "grp") -> Column:
    return F.coalesce(F.upper(F.trim(F.col(group).cast("string"))), F.lit("")).isin(V.MISSING_GROUP_TOKENS)


def missing_group_summary(df: DataFrame, policy: str, group: str = "grp") -> DataFrame:
    """How many rows have no usable group and what the policy does about them."""
    counted = df.agg(count_where(is_missing_group(group)).alias("missing_count"), F.count(F.lit(1)).alias("n"))
    action = {
        "REJECT": "REJECTED_EVALUATION",
        "EXCLUDE": "EXCLUDED_FROM_METRICS",
        "EXPLICIT_UNKNOWN_GROUP": "MAPPED_TO_EXPLICIT_UNKNOWN_GROUP",
        "IMPUTE_WITH_DOCUMENTED_RULE": "IMPUTED_WITH_DOCUMENTED_RULE",
    }[policy]
    some = F.col("missing_count") > 0
    return counted.select(
        F.lit(policy).alias("policy"),
        "missing_count",
        F.coalesce(ratio("missing_count", "n"), F.lit(0.0)).alias("missing_fraction"),
        F.when(some, action).otherwise("NONE").alias("action_taken"),
        F.when(some & F.lit(policy == "REJECT"), V.MISSING_VIOLATION).otherwise(V.VALID).alias("initial_status"),
        F.when(F.lit(policy == "EXCLUDE"), F.col("missing_count"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("excluded_count"),
    )


#: What a record of imputed groups says of itself.
IMPUTATION_NOTE = (
    "Imputed groups count as DERIVED_PROXY: they are no observations of a protected attribute, carry no causal claim "
    "and are no legal evidence."
)


def imputation_struct(missing: Column, rule_id: str | None = None, rule: str | None = None) -> Column:
    """Provenance of imputed groups, given how many rows had none."""
    return F.struct(
        F.lit(rule_id or "RULE-PROXY-DEFAULT").alias("rule_id"),
        F.lit(rule or "Default documented proxy imputation rule").alias("rule_description"),
        missing.cast("bigint").alias("original_missing_count"),
        missing.cast("bigint").alias("imputed_count"),
        F.lit(0).cast("bigint").alias("remaining_missing_count"),
        F.lit("DERIVED_PROXY").alias("sensitive_origin"),
        F.lit(IMPUTATION_NOTE).alias("disclaimer"),
    )


def imputation_record(df: DataFrame, group: str = "grp", rule_id: str | None = None, rule: str | None = None) -> DataFrame:
    """The record as one row; none if no row lacks a group."""
    counted = df.agg(count_where(is_missing_group(group)).alias("m")).filter("m > 0")
    return counted.select(imputation_struct(F.col("m"), rule_id, rule).alias("r")).select("r.*")


def apply_missing_policy(df: DataFrame, policy: str, group: str = "grp") -> DataFrame:
    """Relabel or drop rows without a usable group.

    REJECT still yields metrics, with NULL shown as UNKNOWN; unknown *strings* keep their
    text except under EXPLICIT_UNKNOWN_GROUP.
    """
    g = F.col(group).cast("string")
    missing = is_missing_group(group)
    if policy == "EXCLUDE":
        return df.filter(~missing).withColumn(group, g)
    if policy == "EXPLICIT_UNKNOWN_GROUP":
        return df.withColumn(group, F.when(missing, F.lit("UNKNOWN")).otherwise(g))
    if policy == "IMPUTE_WITH_DOCUMENTED_RULE":
        return df.withColumn(group, F.coalesce(g, F.lit("DERIVED_PROXY_IMPUTED")))
    if policy == "REJECT":
        return df.withColumn(group, F.coalesce(g, F.lit("UNKNOWN")))
    raise ValueError(f"unknown missing-group policy: {policy}")


# --- projections and derived columns ---------------------------------------------------

def contract_columns(contract: DataFrame, table_columns: Sequence[str]) -> list[str]:
    """Columns a feature contract allows before the outcome is known. The contract has one
    row per column, so its names are plan-sized."""
    allowed = {
        r["feature_name"]
        for r in contract.filter(F.col("classification") == "PRE_DISPATCH_VALID").select("feature_name").collect()
    }
    return [c for c in table_columns if c in allowed]


def truthy_flag(c: str) -> Column:
    """Text flag to 0/1: true, 1 and yes count as set."""
    return F.lower(F.trim(F.col(c).cast("string"))).isin("true", "1", "yes").cast("int")


def negated_flag(c: str) -> Column:
    return 1 - truthy_flag(c)


def guarded_ratio(num, den, eps: float = 1e-6) -> Column:
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return num / (den + F.lit(eps))


def clock_hour(c: str) -> Column:
    """Hour of an ``HH:MM:SS`` text, NULL when it does not parse."""
    return F.expr(f"try_cast(split(trim({c}), ':')[0] AS int)").cast("double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def fixed_bins(c: str, edges: Sequence[float], labels: Sequence[str], outside: str = "nan") -> Column:
    """Right-closed bins; a value outside every bin gets the ``outside`` label."""
    value, expr = F.col(c), None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = (value > low) & (value <= high)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(outside)


def top_values(df: DataFrame, c: str, k: int = 5, other: str = "Other") -> DataFrame:
    """Replace all but the ``k`` most frequent values (count ties by value)."""
    top = (
        df.groupBy(F.col(c).cast("string").alias(c))
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), F.asc(c))
        .limit(k)
        .select(c, F.lit(True).alias("__top"))
    )
    joined = attach(df.withColumn(c, F.col(c).cast("string")), top, [c])
    return joined.withColumn(c, F.when(F.col("__top"), F.col(c)).otherwise(other)).drop("__top")


def impute_median(df: DataFrame, c: str) -> DataFrame:
    """Fill NULL and NaN with the exact median."""
    (median,) = exact_quantiles(df, c, [0.5])
    x = F.col(c).cast("double")
    return df.withColumn(c, F.coalesce(F.when(~F.isnan(x), x), F.lit(median)))
