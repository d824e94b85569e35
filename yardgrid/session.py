"""Session settings and durable materialisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on; none of them is specific to one machine.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options on an existing session and return it."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("yardgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def fan_out(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for.

    Used where a small row is about to become hundreds of rows: an explicit number keeps
    adaptive execution from merging partitions on the size they have *before* the growth.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only by a local session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    """One temporary folder for this process, removed when it ends."""
    folder = tempfile.TemporaryDirectory(prefix="yardgrid-")
    atexit.register(folder.cleanup)
    return folder.name


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The result outlives executors, its lineage is cut, later scans read only the columns they
    use, and Spark knows its size. For stages that several operators read and for iterative fits.
    A ``codec`` compresses it otherwise than the session does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    # Removed when the session's file systems are closed.
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
