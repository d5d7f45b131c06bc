"""Session settings and durable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings an audit job wants on any cluster. Partition counts stay with the
#: cluster; AQE coalesces small shuffles and splits skewed ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "evenhand", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.default.parallelism", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that Spark itself uses for the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: it is not computed again, a lost executor costs a
    re-read only, and plans see the size of its files."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/evenhand/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that works on rows from :func:`dealt`.
TASK_ROWS = 10_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows spread by key over as many tasks as their number asks for, up to the session's shuffle partitions.

    A table in one file with one row group is one task, however many rows it has, and so is all that is fitted on it.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(max(1, min(most, -(-df.count() // TASK_ROWS))), *keys)


def stored_bytes(table: DataFrame) -> int:
    """Size of the files of a table from :func:`stored`."""
    spark, size = table.sparkSession, 0
    for name in table.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return size


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint that survives executor loss."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
