"""Table screening: duplicates, impossible values, limits, fingerprints, ingest verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand import vocab as V
from evenhand.functions import text as X
from evenhand.functions.expr import count_where, ratio
from evenhand.operators import leakage
from evenhand.operators.frames import ColumnRoles, missing_columns, numeric_columns
from evenhand.operators.units import entity_profile


def _comparable(df: DataFrame) -> list[Column]:
    """Columns in a form whose JSON text is equal exactly when the values are equal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)  # folds -0.0 into 0.0
        out.append(c.alias(f.name))
    return out


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row. NULL fields are left out of the text, so they equal each other."""
    return F.sha2(F.to_json(F.struct(*_comparable(df))), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Extra copies and their share of the table.

    Rows shrink to a 32-byte digest before the shuffle; copies combine map-side, so a row
    repeated a billion times is still one partial count per task.
    """
    per = df.select(F.unhex(row_digest(df)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("copies"))
    return per.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn("duplicate_fraction", F.coalesce(ratio("duplicate_count", "row_count"), F.lit(0.0)))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content identity: row count and sums of digest slices."""
    d = df.select(row_digest(df).alias("d"))

    def part(i: int) -> Column:
        slice_ = F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("bigint")
        return F.coalesce(F.sum(slice_.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"part_{i}")

    return d.agg(F.count(F.lit(1)).alias("row_count"), *[part(i) for i in range(4)]).withColumn(
        "fingerprint", F.sha2(F.concat_ws("|", "row_count", *[f"part_{i}" for i in range(4)]), 256)
    )


def negative_values(df: DataFrame, fragments: Sequence[str] = ("distance", "time")) -> DataFrame:
    """Negative counts of numeric columns whose name contains a fragment; one pass."""
    names = [c for c in numeric_columns(df) if any(f in c.lower() for f in fragments)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, negative_count bigint")
    wide = df.agg(*[count_where(F.col(f"`{c}`").cast("double") < 0).alias(c) for c in names])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("negative_count"))
                    for c in names
                ]
            )
        )
    )


def json_depth(c: str) -> Column:
    """Nesting levels of a JSON text; a scalar counts as one level and so does the value
    inside an object, so ``{"k": 1}`` is 2 deep and ``{}`` is 1.

    Quoted text is removed first. The running bracket balance peaks at the deepest
    container; a leaf in the deepest container adds one.
    """
    bare = F.regexp_replace(F.col(c), r'"(?:[^"\\]|\\.)*"', "s")
    bare = F.regexp_replace(bare, r"\s+", "")
    # an empty container has no leaf: it is its own last level
    bare = F.regexp_replace(bare, r"\{\}|\[\]", "e")
    steps = F.regexp_extract_all(bare, F.lit(r"[\{\}\[\]]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def walk(acc: Column, s: Column) -> Column:
        now = acc["now"] + F.when(s.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    return F.when(F.col(c).isNotNull(), F.aggregate(steps, start, walk)["top"] + 1)


def within_depth(df: DataFrame, c: str, limit: int = V.MAX_JSON_DEPTH) -> DataFrame:
    """``too_deep``: whether the JSON text of a row nests deeper than the limit (NULL text does not)."""
    return df.withColumn("too_deep", F.coalesce(json_depth(c) > limit, F.lit(False)))


def resource_limits(
    df: DataFrame, max_rows: int | None = None, max_columns: int | None = None
) -> list[str]:
    """Messages for exceeded limits; a limit that is not given does not hold. The row check stops
    after ``max_rows + 1`` rows."""
    out = []
    if max_rows is not None and df.select(F.lit(1)).limit(max_rows + 1).count() > max_rows:
        out.append(f"more than {max_rows} rows")
    if max_columns is not None and len(df.columns) > max_columns:
        out.append(f"{len(df.columns)} columns exceed {max_columns}")
    return out


def hygiene_scan(df: DataFrame, text: str, keys: Sequence[str], sanitize: bool = True) -> DataFrame:
    """Addresses, local paths and secrets of every text, map-only."""
    out = df.select(*keys, *X.hygiene_columns(text, sanitize))
    total = F.size("emails") + F.size("local_paths") + F.size("secrets")
    return out.withColumn("total_found", total).withColumn("clean", F.col("total_found") == 0)


# --- ingest verdict ------------------------------------------------------------------------

MANIFEST = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("target_column", T.StringType()),
        T.StructField("sensitive_columns", T.ArrayType(T.StringType())),
        T.StructField("grouping_column", T.StringType()),
        T.StructField("temporal_column", T.StringType()),
        T.StructField("evaluation_unit_key", T.StringType()),
        T.StructField("duplicate_row_count", T.LongType()),
        T.StructField("duplicate_row_fraction", T.DoubleType()),
        T.StructField("entity_count", T.LongType()),
        T.StructField("min_rows_per_entity", T.LongType()),
        T.StructField("mean_rows_per_entity", T.DoubleType()),
        T.StructField("max_rows_per_entity", T.LongType()),
        T.StructField("leakage_findings_count", T.LongType()),
        T.StructField("has_critical_leakage", T.BooleanType()),
        T.StructField("content_fingerprint", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("validation_messages", T.ArrayType(T.StringType())),
    ]
)


def ingest_manifest(
    df: DataFrame,
    name: str,
    roles: ColumnRoles,
    required: Sequence[str] = (),
    banned: Sequence[str] | None = None,
    max_rows: int | None = None,
    malformed_rows: int = 0,
    max_columns: int | None = None,
) -> DataFrame:
    """Screen a table and record the verdict as one manifest row.

    Every check is one distributed aggregation; only their one-row results meet here.
    """
    spark = df.sparkSession
    fact: dict = {
        "dataset_name": name,
        "column_count": len(df.columns),
        "columns": df.columns,
        "target_column": roles.target,
        "sensitive_columns": list(roles.sensitive),
        "grouping_column": roles.grouping,
        "temporal_column": roles.temporal,
        "evaluation_unit_key": roles.unit_key,
        "row_count": 0,
        "duplicate_row_count": 0,
        "duplicate_row_fraction": 0.0,
        "leakage_findings_count": 0,
        "has_critical_leakage": False,
    }

    def done(status: str, messages: Sequence[str]) -> DataFrame:
        row = tuple({**fact, "status": status, "validation_messages": list(messages)}.get(f.name) for f in MANIFEST)
        return spark.createDataFrame([row], MANIFEST)

    if malformed_rows:
        return done("REJECTED_MALFORMED", [f"{malformed_rows} rows could not be parsed"])
    limits = resource_limits(df, max_rows, max_columns)
    if limits:
        return done("REJECTED_SIZE", limits)
    absent = missing_columns(df, roles) + [f"feature column '{c}' missing" for c in required if c not in df.columns]
    if absent:
        return done("REJECTED_SCHEMA", absent)

    messages: list[str] = []
    dup = duplicate_rows(df).first()
    fact["row_count"], fact["duplicate_row_count"] = dup["row_count"], dup["duplicate_count"]
    fact["duplicate_row_fraction"] = dup["duplicate_fraction"]
    fact["content_fingerprint"] = table_fingerprint(df).first()["fingerprint"]
    if dup["duplicate_count"]:
        messages.append(f"{dup['duplicate_count']} duplicate rows ({dup['duplicate_fraction']:.2%})")
    for r in negative_values(df).filter("negative_count > 0").orderBy("column_name").collect():
        messages.append(f"column '{r['column_name']}' has {r['negative_count']} impossible negative values")
    if roles.unit_key:
        p = entity_profile(df, roles.unit_key).first()
        fact["entity_count"] = p["unit_cardinality"]
        fact["min_rows_per_entity"], fact["max_rows_per_entity"] = p["min_rows"], p["max_rows"]
        fact["mean_rows_per_entity"] = p["mean_rows"]
        messages.append(f"unit '{roles.unit_key}': {p['unit_cardinality']} entities in {dup['row_count']} rows")
    classes = df.select(roles.target).na.drop().distinct().limit(2).count()
    status = "PASSED"
    if classes < 2:
        status = "REJECTED_MALFORMED"
        messages.append(f"target '{roles.target}' has fewer than two classes")
    found = leakage.feature_findings(df, roles.target, dataset=name, known=banned)
    rows = found.select("status", "severity").collect()  # at most three per column
    fact["leakage_findings_count"] = len(rows)
    critical = any(r["status"] == "CONFIRMED_LEAKAGE" and r["severity"] in ("CRITICAL", "HIGH") for r in rows)
    present = [c for c in (banned or []) if c in df.columns]
    if present:
        critical = True
        messages.append(f"banned columns present: {present}")
    fact["has_critical_leakage"] = critical
    if critical:
        messages.append("the table holds outcome or post-outcome features")
        return done("REJECTED_LEAKAGE", messages)
    if messages and status == "PASSED":
        status = "PASSED_WITH_WARNINGS"
    return done(status, messages)
