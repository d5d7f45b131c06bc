"""Small registries as tables: provenance, attribute profiles, units, feature contracts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.operators.order import attach

# Older spellings of registry values.
ORIGIN_ALIASES = {"REPORTED_DEMOGRAPHIC": "REAL_OBSERVED"}
DATASET_TYPE_ALIASES = {"REAL_EXTERNAL": "REAL_DATA"}
CLASSIFICATION_ALIASES = {
    "SYNTHETIC_VERIFIED": "SYNTHETIC_DGP_VALIDATION",
    "SYNTHETIC_EXPLORATORY": "EXPLORATORY",
    "EXTERNAL_AUDIT_READY": "EXTERNAL_REAL_DATA_VALIDATION",
    "FRAMEWORK_VALIDATION": "INTERNAL_ENGINEERING_VERIFICATION",
}

PROVENANCE = (
    "dataset_name string, dataset_type string, source_reference string, version_or_date string, license_notes string, "
    "target_definition string, sensitive_attributes array<string>, sensitive_origin string, "
    "feature_timing_contract string, expected_grouping_key string, expected_temporal_key string, "
    "redistribution_status string, sha256_fingerprint string, verified_licensing boolean, notes string"
)
PROFILE = (
    "dataset_name string, attribute_name string, origin string, generation_inputs array<string>, "
    "inputs_in_model_features boolean, inputs_influence_target boolean, inputs_post_outcome boolean, "
    "represents_real_demographic boolean, causal_interpretation_meaningful boolean, rationale string"
)
CONTRACT = "dataset_name string, feature_name string, classification string, role string, justification string"
UNITS = (
    "dataset_name string, natural_decision_unit string, raw_record_unit string, evaluation_unit_key string, "
    "group_key string, cluster_key string, timestamp_key string, target_strategy string, prediction_strategy string, "
    "estimand_status string"
)


def _canonical(column: str, aliases: dict[str, str]):
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(lookup[F.col(column)], F.col(column))


def canonical_origins(df: DataFrame, column: str = "sensitive_origin") -> DataFrame:
    return df.withColumn(column, _canonical(column, ORIGIN_ALIASES))


def canonical_classification(df: DataFrame, column: str = "result_classification") -> DataFrame:
    return df.withColumn(column, _canonical(column, CLASSIFICATION_ALIASES))


def records(spark: SparkSession, rows: Sequence[dict[str, Any]], schema: str) -> DataFrame:
    """Registry rows with the fields they have; absent ones are NULL."""
    empty = spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], schema)


def provenance(spark: SparkSession, rows: Sequence[dict[str, Any]]) -> DataFrame:
    df = canonical_origins(records(spark, rows, PROVENANCE))
    df = df.withColumn("dataset_type", _canonical("dataset_type", DATASET_TYPE_ALIASES))
    return df.na.fill({"redistribution_status": "RESTRICTED", "verified_licensing": False, "notes": ""})


def read_yaml_rows(spark: SparkSession, path: str, section: str) -> list[dict[str, Any]]:
    """Rows of a registry file, from any store that Spark reads: a list of records, or a map whose values are records.

    Registries are configuration of a few rows; the file is read on the driver.
    """
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    part = (yaml.safe_load(text["value"]) if text else None) or {}
    part = part.get(section) or []
    return list(part.values()) if isinstance(part, dict) else list(part)


def load_provenance(spark: SparkSession, path: str) -> DataFrame:
    return provenance(spark, read_yaml_rows(spark, path, "provenance_records"))


def lookup(df: DataFrame, registry: DataFrame, key: str, registry_key: str = "dataset_name") -> DataFrame:
    """Left join with a registry (size-checked broadcast)."""
    return attach(df, registry.withColumnRenamed(registry_key, key), [key])
