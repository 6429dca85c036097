"""Streaming jobs over finished and submitted batch jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from jobcast.functions.scalar import inf_to_null, instant_utc, naive_utc
from jobcast.operators.dictionary import encode_with
from jobcast.operators.metrics import BIAS_TYPES
from jobcast.plans.models import StoredModels, placed_jobs
from jobcast.plans.train import score
from jobcast.session import fresh_path
from jobcast.sources.versions import Versions


def stream_window_stats(stream: DataFrame, ts: str, size: str, slide: str, watermark: str,
                        offset: str = "0 seconds", wait: str = "wait_time",
                        run: str = "run_time") -> DataFrame:
    """Job count, mean wait and mean run time per sliding window of finished jobs.

    Partial aggregates per window keep the state to one row per open window;
    rows later than the watermark are dropped.
    """
    naive = isinstance(stream.schema[ts].dataType, TimestampNTZType)  # watermarks need instants
    timed = stream.withColumn("__ts", instant_utc(F.col(ts)) if naive else F.col(ts)).withWatermark("__ts", watermark)
    return timed.groupBy(F.window("__ts", size, slide, offset)).agg(
        F.count("*").alias("n_jobs"), F.avg(wait).alias("mean_wait"), F.avg(run).alias("mean_run")).select(
        naive_utc(F.col("window.start")).alias("window_start"),
        naive_utc(F.col("window.end")).alias("window_end"), "n_jobs", "mean_wait", "mean_run")


def run_available(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process all available input in append mode into Parquet and return the result table."""
    root = fresh_path(spark, name)
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("path", root + "/out").option("checkpointLocation", root + "/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(root + "/out")


class Serving:
    """The models that a service answers with: those of one window of the store's newest version.

    ``refresh`` asks the store for its newest version, with one listing, and reads models, centres and buffers anew if it
    has changed. The driver holds the models of the serving window, no others.
    """

    def __init__(self, spark: SparkSession, root: str, bias_type: str, window=None) -> None:
        if bias_type not in BIAS_TYPES:
            raise ValueError(f"unknown bias type {bias_type!r}; choose from {list(BIAS_TYPES)}")
        self.spark, self.root, self.bias_type, self.window = spark, root, bias_type, window
        self.version = self.trained = self.centers = None
        self.models: dict[tuple, dict[str, object]] = {}
        self.buffers: dict[tuple, float] = {}

    def refresh(self) -> None:
        newest = Versions(self.spark, self.root).newest()
        if newest is None:
            raise ValueError(f"no models have been published under {self.root}")
        if newest == self.version:
            return
        trained = StoredModels(self.spark, self.root, newest)
        window = self.window or trained.newest_window()
        per_window = "window_start" in trained.by
        place = trained.by.index("window_start") if per_window else None
        groups = [g for g in trained.groups() if not per_window or str(g[place]) == str(window)]
        if not groups:
            raise ValueError(f"version {newest} has no models for window {window}")
        centers, biases = trained.centers, trained.biases
        if per_window:
            kind = trained.manifest.schema["window_start"].dataType
            own = F.col("window_start") == F.lit(str(window)).cast(kind)
            biases = biases.where(own)
            centers = centers.where(own).drop("window_start") if centers is not None else None
        buffers = {}
        if self.bias_type != "none":
            # one row for each cluster and model of the serving window
            buffers = {(tuple(r[c] for c in trained.by), r["model"]): r[self.bias_type] or 0.0 for r in biases.collect()}
        self.models = {g: trained.of(g) for g in groups}
        self.trained, self.centers, self.buffers, self.version = trained, centers, buffers, newest

    def suggest(self, jobs: DataFrame, key: str) -> DataFrame:
        """(key, cluster, model, suggested, version) of each job without a gap: nearest centre, that cluster's models, buffer."""
        features = list(self.trained.features)
        clean = inf_to_null(jobs).na.drop("any", subset=features).withColumns({c: F.col(c).cast("double") for c in features})
        if self.centers is not None:
            clean = placed_jobs(clean.drop("cluster"), features, self.centers)
        elif "cluster" not in clean.columns:
            clean = clean.withColumn("cluster", F.lit(None).cast("int"))
        clean = clean.withColumn("__none", F.lit(None).cast("double"))
        parts = []
        for group, models in self.models.items():
            own = [F.col("cluster") == v for c, v in zip(self.trained.by, group) if c == "cluster"]
            scored = score(clean.where(own[0]) if own else clean, models, features, "__none", [key, "cluster"])
            pairs = [F.lit(x) for m in models for x in (m, float(self.buffers.get((group, m), 0.0)))]
            parts.append(scored.select(key, "cluster", "model", (F.col("pred") + F.create_map(*pairs)[F.col("model")]).alias("suggested"),
                                       F.lit(self.version).alias("version")))
        return reduce(DataFrame.unionByName, parts)


def stream_suggest(stream: DataFrame, root: str, bias_type: str, sink: str, window=None, key: str = "job_id",
                   trigger: dict | None = None, dictionary: str | None = None,
                   categories: Sequence[str] = ()) -> StreamingQuery:
    """Write suggestions for submitted jobs under ``sink``, one folder per micro-batch.

    ``root`` is a model store; its newest version, and in it the newest window unless ``window`` names one, is looked up at
    each micro-batch, so that the service goes on while models are trained again. ``trigger`` says when batches run, as in
    ``DataStreamWriter.trigger``; by default all available input is processed and the query ends. With ``dictionary``
    the raw ``categories`` get the codes of its newest version, a value it does not know -1. A batch that is
    run again replaces its own folder, so no suggestion is doubled; ``version`` tells which models made it.
    """
    serving = Serving(stream.sparkSession, root, bias_type, window)

    def write(batch: DataFrame, batch_id: int) -> None:
        serving.refresh()
        rows = encode_with(batch, categories, dictionary) if dictionary else batch
        rows = rows.persist()  # each cluster's models read the batch once
        try:
            serving.suggest(rows, key).write.mode("overwrite").parquet(f"{sink}/out/batch={batch_id}")
        finally:
            rows.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", sink + "/state")
            .trigger(**(trigger or {"availableNow": True})).start())
