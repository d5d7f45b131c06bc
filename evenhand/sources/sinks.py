"""CSV and JSON sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.session import shared_dir

#: First characters that a spreadsheet takes for a formula.
FORMULA_START = r"^[=+\-@\t\r]"


def sanitized(df: DataFrame) -> DataFrame:
    """Text that would start a formula gets a leading apostrophe."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, sanitize: bool = False, mode: str = "errorifexists") -> None:
    """Partitioned CSV with header; quotes are doubled so that any text survives the trip."""
    df = sanitized(df) if sanitize else df
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line with sorted keys."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_framed_json(lines: DataFrame, path: str, frame: str = "[]", mode: str = "errorifexists") -> None:
    """One object or array per task's file: the lines between the two characters of ``frame``, commas between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = frame[0]
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                values = b.column(0).slice(a, 1000).to_pylist()
                yield pa.record_batch([pa.array([f"{lead if i == 0 else ','}{v}" for i, v in enumerate(values)], pa.string())], names=["value"])
                lead = ","
        yield pa.record_batch([pa.array([frame[1] if lead == "," else frame], pa.string())], names=["value"])

    lines.mapInArrow(run, "value string").write.mode(mode).text(path)


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An array of records per file, sorted keys, nulls kept."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    write_framed_json(df.select(record.alias("value")), path, "[]", mode)


def write_keyed_json(df: DataFrame, key: str, path: str, mode: str = "errorifexists") -> None:
    """A map from ``key`` to the record of the other columns per file."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != key]), {"ignoreNullFields": "false"})
    name = F.regexp_extract(F.to_json(F.struct(F.col(f"`{key}`").cast("string").alias("k"))), r'^\{"k":(.*)\}$', 1)
    write_framed_json(df.select(F.concat(name, F.lit(":"), record).alias("value")), path, "{}", mode)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ``document`` texts, one per line."""
    df.select("document").write.mode(mode).text(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/evenhand/{name}-{uuid.uuid4().hex}"
