"""The store of prediction frames: runs in folders of their own, and a manifest of which run gives which experiment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobcast.session import gathered
from jobcast.sources.versions import Versions

PARTITIONS = ("trace", "target", "model", "bias", "window_size", "window_start")
SCHEMA = (
    "job_id bigint, cluster int, pred double, act double, req double, trace string, target string, "
    "model string, bias string, window_size int, window_start timestamp_ntz"
)


def among(df: DataFrame, chosen: dict[str, Sequence | None]) -> Column:
    """Rows whose partition columns have the chosen values; None chooses all."""
    conditions = [F.col(c).isin(*[F.lit(str(x)).cast(df.schema[c].dataType) for x in values]) for c, values in chosen.items() if values is not None]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def sink_predictions(df: DataFrame, root: str, replaces: dict[str, Sequence] | None = None) -> str:
    """Write the frames of a run under ``root`` and make them visible at once; returns the run's name.

    The run has a folder of its own. A manifest, one row for each partition and the run that gives it, follows; publishing it is
    one step, so a reader sees the store as it was before or with all of the run, and a run that stops leaves the store as it was.
    Partitions that ``df`` has replace their older ones; ``replaces`` names whole experiments (values of partition
    columns) of which nothing else is to stay.
    """
    spark, versions = df.sparkSession, Versions(df.sparkSession, root)
    run, newest = versions.begin(), versions.newest()
    path = f"{versions.folder(run)}/rows"
    gathered(df, PARTITIONS).write.partitionBy(*PARTITIONS).parquet(path)
    written = spark.read.schema(df.schema).parquet(path).select(*PARTITIONS).distinct()
    own = written.withColumn("of_run", F.lit(written.count())).withColumn("run", F.lit(run))
    manifest = own
    if newest:
        older = versions.table("manifest", newest).join(own.select(*PARTITIONS), list(PARTITIONS), "left_anti")
        if replaces:
            older = older.where(~among(older, replaces))
        manifest = own.unionByName(older)
    manifest.coalesce(1).write.parquet(f"{versions.folder(run)}/manifest")
    versions.publish(run)
    return run


def scan_predictions(spark: SparkSession, root: str, models: Sequence[str] | None = None,
                     biases: Sequence[str] | None = None, windows: Sequence | None = None,
                     schema: str | StructType = SCHEMA, traces: Sequence[str] | None = None, targets: Sequence[str] | None = None,
                     window_sizes: Sequence[int] | None = None) -> DataFrame:
    """Results of the chosen experiments, as the newest manifest has them; other partitions are not read.

    Job ids are read as whole numbers; pass a ``schema`` with another type for traces that name jobs otherwise.
    """
    versions = Versions(spark, root)
    manifest = versions.table("manifest")
    chosen = {"model": models, "bias": biases, "window_start": windows, "trace": traces, "target": targets, "window_size": window_sizes}
    # one row for each run that still gives some partition
    runs = manifest.groupBy("run").agg(F.first("of_run").alias("of_run"), F.count("*").alias("current"),
                                       F.count_if(among(manifest, chosen)).alias("chosen")).where("chosen > 0").orderBy("run").collect()
    parts = []
    for r in runs:
        rows = spark.read.schema(schema).parquet(f"{versions.folder(r['run'])}/rows")
        rows = rows.where(among(rows, chosen))
        if r["current"] < r["of_run"]:  # later runs have replaced some of its partitions
            own = manifest.where(F.col("run") == r["run"]).select(*PARTITIONS)
            rows = rows.join(own, list(PARTITIONS), "left_semi")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def clean_predictions(spark: SparkSession, root: str) -> list[str]:
    """Delete runs of which the newest manifest names no partition; for a time when nobody writes."""
    versions = Versions(spark, root)
    used = [r["run"] for r in versions.table("manifest").select("run").distinct().collect()]  # one row per run
    return versions.clean(also=used)
