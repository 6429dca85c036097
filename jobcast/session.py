"""Session settings and the shared folder for stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    folder = tempfile.mkdtemp(prefix="jobcast-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("jobcast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.warehouse.dir", folder + "/warehouse")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """Root for stored intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may do without the setting; a machine-local folder
    would be lost with its executor on a cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="jobcast-")
    return _LOCAL_FOLDERS[app]


def own_folder(spark: SparkSession) -> str:
    return f"{workspace(spark)}/jobcast/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder name below the workspace that nothing else uses."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; frames that read them can be used no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring the rows of an output partition together before writing it.

    Otherwise every task would add a file to every partition. Adaptive
    execution splits a large partition among several tasks and merges small ones.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table.

    Cuts the lineage, survives lost executors and, unlike a row checkpoint,
    keeps column and partition pruning for whoever reads it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    gathered(df, partition_by).write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
