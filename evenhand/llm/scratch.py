"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evenhand.session import shared_dir


class Scratch:
    """Writes intermediate tables as Parquet where all executors reach them, and removes them.

    A table cuts the lineage, survives the loss of executors, and has the size of its files in plans (a checkpointed
    frame keeps the estimate of its old plan, and estimates of joins multiply).
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/evenhand/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def path(self) -> str:
        return f"{self.root}/{len(self.held)}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)
        return out

    def drop(self, keep: list[DataFrame] = ()) -> None:
        """Remove all tables but those to keep."""
        stay = {id(x) for x in keep}
        for key in [k for k in self.paths if k not in stay]:
            remove(self.spark, self.paths.pop(key))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
