"""Windowed experiments: slice, split, group, train, score, store."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.functions.filters import check_features, drop_incomplete
from jobcast.functions.scalar import inf_to_null
from jobcast.operators.scaling import attach
from jobcast.operators.sampling import split_exact, split_hash
from jobcast.operators.windows import assign_windows_sliding, nearest_center, window_table
from jobcast.plans.ledger import Ledger
from jobcast.plans.train import FIT_THREADS, GROUP, fit_and_score, of_group, prepare_rows
from jobcast.session import fresh_path, store
from jobcast.sources.predictions import SCHEMA, scan_predictions, sink_predictions
from jobcast.spec import TraceSpec

TEST_FRACTION = 0.2
TEST_SEED = 33
GROUPED = ("clustering_xgb", "clustering_rf", "resampled_xgb", "resampled_rf")


def windowed_jobs(df: DataFrame, spec: TraceSpec, exact_split: bool = False) -> DataFrame:
    """Jobs of every window with their test flag, from a hash or as an exact share of the window."""
    windows = window_table(df.sparkSession, spec.first_window, spec.last_window, spec.window_days,
                           spec.window_step)
    sliced = assign_windows_sliding(inf_to_null(df), windows, spec.end).drop("window_end")
    if exact_split:
        return split_exact(sliced, spec.key, ["window_start"], TEST_FRACTION, TEST_SEED)
    return split_hash(sliced, spec.key, TEST_FRACTION, TEST_SEED)


def used_columns(spec: TraceSpec) -> list[str]:
    extra = [spec.request] if spec.request else []
    return list(dict.fromkeys(["window_start", "is_test", spec.key, *spec.features, spec.target, *extra]))


def fit_centers(train: DataFrame, work: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """K-means centres of every window; windows are fitted side by side, each on its own partition."""
    spark = train.sparkSession
    windows = [r["window_start"] for r in train.select("window_start").distinct().collect()]
    assembler = VectorAssembler(inputCols=list(work), outputCol="__vec")

    def fit(window) -> list[tuple]:
        rows = of_group(train, ["window_start"], (window,))
        model = KMeans(k=k, seed=seed, featuresCol="__vec").fit(assembler.transform(rows).select("__vec"))
        return [(window, i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]

    with ThreadPoolExecutor(FIT_THREADS) as pool:
        rows = [row for part in pool.map(fit, windows) for row in part]
    kind = train.schema["window_start"].dataType.simpleString()
    return spark.createDataFrame(rows, f"window_start {kind}, cluster int, center array<double>")


def grouped_jobs(df: DataFrame, spec: TraceSpec, exact_split: bool = False, ledger: Ledger | None = None) -> DataFrame:
    """Windowed jobs with their cluster; with a ``ledger``, by the centres of its first run.

    Training rows are placed with gaps filled by the window's means; test rows
    by their own values, those with a gap having no cluster. Incomplete rows
    take part in grouping and are left out afterwards.
    """
    check_features(df, spec.features)
    jobs = windowed_jobs(df, spec, exact_split)
    gap = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in jobs.columns])
    jobs = jobs.withColumn("__gap", gap)
    kept = store(jobs.select(*used_columns(spec), "__gap"), "windowed", ("window_start",))
    work = {f: f"__f{i}" for i, f in enumerate(spec.features)}
    means = store(kept.where(~F.col("is_test")).groupBy("window_start").agg(
        *[F.avg(f).alias("__m" + w) for f, w in work.items()]), "window-means")
    filled = attach(kept, means, ["window_start"]).withColumns({
        w: F.when(F.col("is_test"), F.col(f).cast("double")).otherwise(
            F.coalesce(F.col(f).cast("double"), F.col("__m" + w))) for f, w in work.items()})
    filled = filled.drop(*["__m" + w for w in work.values()])
    def centers_of() -> DataFrame:
        return fit_centers(filled.where(~F.col("is_test")), list(work.values()), spec.clusters)

    centers = ledger.kept("centers", centers_of) if ledger else centers_of()
    placed = nearest_center(filled, list(work.values()), centers, ["window_start"])
    return placed.where(F.col("cluster").isNotNull() & ~F.col("__gap")).drop(*work.values(), "__gap")


def as_results(preds: DataFrame, spec: TraceSpec) -> DataFrame:
    """Prediction frames in the layout of the result store."""
    if "cluster" not in preds.columns:
        preds = preds.withColumn("cluster", F.lit(None).cast("int"))
    if "req" not in preds.columns:
        preds = preds.withColumn("req", F.lit(None).cast("double"))
    keyed = preds.withColumnRenamed(spec.key, "job_id")
    named = keyed.withColumns({
        "trace": F.lit(spec.name), "target": F.lit(spec.target),
        "window_size": F.lit(spec.window_days), "window_start": F.col("window_start").cast("timestamp_ntz")})
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return named.select(*names)


def ledger_of(df: DataFrame, resume: str | None, spec: TraceSpec, preset: str, exact_split: bool) -> Ledger | None:
    """The ledger of experiments with these settings below ``resume``; the trace itself must be the same."""
    return Ledger(df.sparkSession, resume, (spec.with_(biases=()), preset, exact_split)) if resume else None


def experiment_baseline(df: DataFrame, spec: TraceSpec, preset: str = "reference",
                        root: str | None = None, exact_split: bool = False, resume: str | None = None) -> DataFrame:
    """One model per window over all its jobs; returns the stored predictions. See ``experiment_grouped`` for ``resume``."""
    jobs = drop_incomplete(windowed_jobs(df, spec, exact_split)).select(*used_columns(spec))
    rows = prepare_rows(jobs, spec.features, spec.target, ["window_start"], spec.key, spec.request, ["is_test"])
    preds = fit_and_score(rows, spec.features, spec.target, ["baseline"], preset, spec.biases,
                          ["window_start"], spec.key, ledger=ledger_of(df, resume, spec, preset, exact_split))
    return kept_results(preds, spec, root, ["baseline"])


def experiment_grouped(df: DataFrame, spec: TraceSpec, preset: str = "reference",
                       variants: Sequence[str] = GROUPED, root: str | None = None,
                       exact_split: bool = False, resume: str | None = None) -> DataFrame:
    """K-means groups per window and one model per group and variant; returns the stored predictions.

    With ``resume``, a folder, each group's scored rows are kept there as soon as its models have been fitted. A run that
    stopped and is started again on the same trace fits the groups and variants that are missing, no others.
    """
    ledger = ledger_of(df, resume, spec, preset, exact_split)
    rows = prepare_rows(grouped_jobs(df, spec, exact_split, ledger), spec.features, spec.target, GROUP, spec.key,
                        spec.request, ["is_test"])
    preds = fit_and_score(rows, spec.features, spec.target, variants, preset, spec.biases, GROUP, spec.key, ledger=ledger)
    return kept_results(preds, spec, root, variants)


def kept_results(preds: DataFrame, spec: TraceSpec, root: str | None, models: Sequence[str]) -> DataFrame:
    spark = preds.sparkSession
    root = root or fresh_path(spark, "predictions")
    results = as_results(preds, spec)
    sink_predictions(results, root, {"trace": [spec.name], "target": [spec.target], "model": models, "bias": spec.biases,
                                     "window_size": [spec.window_days]})
    schema = SCHEMA.replace("job_id bigint", f"job_id {results.schema['job_id'].dataType.simpleString()}")
    return scan_predictions(spark, root, models, spec.biases, None, schema, [spec.name], [spec.target], [spec.window_days])
