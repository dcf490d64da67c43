"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "corpusloom", shuffle: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    known = getattr(spark, "_loom_scratch", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="loom-")
        spark._loom_scratch = known
    return known


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and go on from there.

    Unlike an RDD checkpoint the table keeps column pruning, filter push-down and size
    statistics, and it survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._loom_path = path
    return table


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def sweep(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished jobs: it does so once the driver has collected their plans."""
    spark._jvm.System.gc()


def drop(*cuts: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more, and sweep."""
    spark = cuts[0].sparkSession
    for table in cuts:
        path, fs = hadoop_path(spark, table._loom_path)
        fs.delete(path, True)
    sweep(spark)


def tables(spark: SparkSession, sf_dir: str):
    """Reader of the driver tables by name."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read
