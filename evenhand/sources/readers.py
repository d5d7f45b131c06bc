"""Typed readers: CSV with and without header, JSON arrays, keyed-map JSON, audit documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.operators.order import attach
from evenhand.sources.split_json import RANGE_BYTES, json_entries

BAD = "_corrupt_record"


def _with_bad(schema: str | T.StructType) -> T.StructType:
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return T.StructType([*s.fields, T.StructField(BAD, T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Header CSV with a stated schema. Rows that do not parse keep their text in
    ``_corrupt_record``; split with :func:`good_rows` and :func:`malformed_count`."""
    return (
        spark.read.schema(_with_bad(schema))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("escape", '"')
        .option("multiLine", False)
        .csv(path)
    )


def read_headerless_csv(
    spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, null_value: str = "?", label: str | None = None,
    banner: str | None = r"^\|",
) -> DataFrame:
    """Stacked files without header: blanks after commas dropped, ``?`` is NULL, a trailing dot cut
    from the label. Only lines that match ``banner`` are left out; other lines that do not have the
    columns of the schema stay with their text in ``_corrupt_record``, as in :func:`read_csv`."""
    df = (
        spark.read.schema(_with_bad(schema))
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", null_value)
        .csv(list(paths))
    )
    if banner is not None:
        df = df.filter(F.col(BAD).isNull() | ~F.col(BAD).rlike(banner))
    return df.withColumn(label, F.rtrim(F.regexp_replace(label, r"\.$", ""))) if label else df


def good_rows(df: DataFrame) -> DataFrame:
    """Rows that parse. The second condition always holds; it makes the scan look at every
    field even when later steps need only some."""
    data = [F.col(c) for c in df.columns if c != BAD]
    return df.filter(F.col(BAD).isNull() & (F.hash(*data) >= F.lit(-(2**31)))).drop(BAD)


def parse_report(df: DataFrame) -> DataFrame:
    """``malformed, n`` of a read with ``_corrupt_record``. Every data column goes into a
    checksum, since a pruned CSV scan would not look at fields it does not need."""
    data = [F.col(c) for c in df.columns if c != BAD]
    return df.agg(
        F.count(BAD).alias("malformed"),
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*data)).alias("checksum"),
    ).filter(F.col("checksum").isNotNull() | (F.col("n") == 0))


def malformed_count(df: DataFrame) -> int:
    return parse_report(df).first()["malformed"]


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """An array of records per file, read by byte range. Entries that do not parse, or not to the
    schema, keep their text in ``_corrupt_record``, as in :func:`read_csv`."""
    entries = json_entries(spark, path, range_bytes)
    record = F.from_json("value", _with_bad(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = entries.select(record.alias("r"), "value", "problem")
    names = [f.name for f in _with_bad(schema).fields if f.name != BAD]
    lost = F.col("problem").isNotNull()
    cols = [F.when(~lost, F.col(f"r.`{c}`")).alias(c) for c in names]
    bad = F.when(lost | F.col(f"r.{BAD}").isNotNull(), F.coalesce(F.col("value"), F.lit("")))
    return rows.select(*cols, bad.alias(BAD))


def read_json_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The records of arrays that parse."""
    rows = read_json_array(spark, path, schema)
    return rows.filter(F.col(BAD).isNull()).drop(BAD)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def explode_keyed(df: DataFrame, text: str | Column, record: str, key: str = "id") -> DataFrame:
    """``{id: record}`` JSON text to one row per id; entries that are no objects fall away."""
    c = F.col(text) if isinstance(text, str) else text
    exploded = df.select("*", F.explode(F.from_json(c, f"map<string,{record}>")).alias(key, "record"))
    return exploded.filter(F.col("record").isNotNull())


ROUTE = (
    "struct<route_score:string,station_code:string,departure_time_utc:string,executor_capacity_cm3:double,"
    "stops:map<string,struct<lat:string,lng:string,type:string>>>"
)


def read_keyed_json(spark: SparkSession, path: str, record: str, key: str = "id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``key, record`` of files that map ids to records, read by byte range, with the text of what
    does not parse in ``_corrupt_record``. A key that is repeated has a row each time."""
    entries = json_entries(spark, path, range_bytes)
    lost = F.col("problem").isNotNull() | F.col("key").isNull()
    value = F.when(~lost, F.from_json("value", record))
    return entries.select(F.col("key").alias(key), value.alias("record"), F.when(lost, F.col("value")).alias(BAD))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Route files: map of route id to record. Blank scores are left out."""
    routes = read_keyed_json(spark, path, ROUTE, "route_id").filter(F.col(BAD).isNull()).select("route_id", "record.*")
    return routes.filter(F.trim(F.coalesce("route_score", F.lit(""))) != "")


def _points(stops: Column) -> Column:
    return F.filter(
        F.transform(
            F.map_values(stops),
            lambda s: F.struct(
                s["lat"].try_cast("double").alias("lat"), s["lng"].try_cast("double").alias("lng"), s["type"].alias("type")
            ),
        ),
        lambda p: p["lat"].isNotNull() & p["lng"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lng"]),
    )


def nested_stop_features(routes: DataFrame, stops: str = "stops") -> DataFrame:
    """Per-route features of a nested stop map, without a shuffle: the stops of a route are in
    its row already. Routes with fewer than two valid points are left out."""
    df = routes.withColumn("__p", _points(F.col(stops))).filter(F.size("__p") >= 2)
    n = F.size("__p").cast("double")

    def total(f) -> Column:
        return F.aggregate("__p", F.lit(0.0), lambda acc, p: acc + f(p))

    df = df.withColumn("lat_mean", total(lambda p: p["lat"]) / n).withColumn("lng_mean", total(lambda p: p["lng"]) / n)
    lat, lng = F.transform("__p", lambda p: p["lat"]), F.transform("__p", lambda p: p["lng"])
    d_lat, d_lng = (lambda p: p["lat"] - F.col("lat_mean")), (lambda p: p["lng"] - F.col("lng_mean"))
    return df.select(
        *[c for c in routes.columns if c != stops],
        n.alias("num_stops_total"),
        total(lambda p: (p["type"] == "Dropoff").cast("double")).alias("num_dropoffs"),
        "lat_mean",
        "lng_mean",
        F.sqrt(total(lambda p: d_lat(p) * d_lat(p)) / n).alias("lat_std"),
        F.sqrt(total(lambda p: d_lng(p) * d_lng(p)) / n).alias("lng_std"),
        ((F.array_max(lat) - F.array_min(lat)) * (F.array_max(lng) - F.array_min(lng))).alias("bbox_area"),
        (total(lambda p: F.sqrt(d_lat(p) * d_lat(p) + d_lng(p) * d_lng(p))) / n).alias("radial_dispersion"),
    )


def stop_features(stops: DataFrame, route: str = "route_id") -> DataFrame:
    """The same features from one row per stop (``lat, lng, type``). The centroid of every route
    goes back to its stops by a size-checked, skew-safe lookup for the dispersion."""
    valid = stops.filter(
        F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng")
    )
    base = valid.groupBy(route).agg(
        F.count(F.lit(1)).cast("double").alias("num_stops_total"),
        F.sum((F.col("type") == "Dropoff").cast("double")).alias("num_dropoffs"),
        F.avg("lat").alias("lat_mean"),
        F.avg("lng").alias("lng_mean"),
        F.stddev_pop("lat").alias("lat_std"),
        F.stddev_pop("lng").alias("lng_std"),
        ((F.max("lat") - F.min("lat")) * (F.max("lng") - F.min("lng"))).alias("bbox_area"),
    ).filter("num_stops_total >= 2")
    centred = attach(valid, base.select(route, "lat_mean", "lng_mean"), [route], "inner")
    away = F.sqrt(F.pow(F.col("lat") - F.col("lat_mean"), 2) + F.pow(F.col("lng") - F.col("lng_mean"), 2))
    dispersion = centred.groupBy(route).agg(F.avg(away).alias("radial_dispersion"))
    return base.join(dispersion, route)


def attach_scores(df: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Dictionary lookup of a score by id; ids without one keep NULL."""
    return attach(df, scores, [key])


def stable_cap(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """The first rows in key order (a file has no order of its own here)."""
    return df.orderBy(*key).limit(rows)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Audit documents, one JSON text per line, as the ``document`` column."""
    return spark.read.text(path).withColumnRenamed("value", "document")
