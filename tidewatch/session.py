"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting to remove the shuffle files of an action when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(master)
        .appName("tidewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a folder of its own; a cluster session
    without it is an error, as a machine-local folder would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="tidewatch-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def uneven(df: DataFrame) -> bool:
    """Whether a scan leaves cores idle: fewer files than cores, and one task with over 1.5 times its share.

    A large file is cut into many tasks by its row groups, so files alone do not tell. The count
    takes no column: of Parquet only the footers are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return False
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return max(rows, default=0) * cores > 1.5 * sum(rows)


def spread(df: DataFrame) -> DataFrame:
    """A scan that leaves cores idle, spread over them; any other as it is, without a shuffle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if uneven(df) else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action within go when it has ended; for actions whose result is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def drop_scratch(df: DataFrame, name: str) -> None:
    """Remove the scratch tables called ``name`` that ``df`` reads; for when it has been written."""
    marker = f"/tidewatch/{name}-"
    found = {file[:file.index("/", file.index(marker) + len(marker))] for file in df.inputFiles() if marker in file}
    for path in found:
        drop_path(df.sparkSession, path)
