"""Session defaults and the few settings the library reads back from a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What a session needs for the library's results to be reproducible.  Sizing (executor memory,
# number of shuffle partitions) is left to the cluster; AQE coalesces what turns out small.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites captured for every column expression double the time it takes to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tallycast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    A folder set on the context counts as well.  Only a ``local`` master, where there is one machine, gets a
    temporary folder when none is named; on a cluster that is an error, since executors would not see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tallycast-")
        context.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else f"file://{named}" if named.startswith("/") else named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tallycast/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, for tables that several branches of a plan read.

    Lineage ends at the files, which any executor can read, so a lost executor loses nothing; later scans read
    only the columns they need, and the optimizer knows the table's size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark: shuffle width matches the cores, no UI port."""
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.default.parallelism": str(cpus),
        "spark.driver.memory": os.environ.get("TALLYCAST_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("tallycast-local", f"local[{cpus}]", **{**base, **conf})
    spark.sparkContext.setLogLevel("ERROR")
    return spark
