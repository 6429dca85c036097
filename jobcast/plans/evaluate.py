"""Stored predictions to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobcast.operators.metrics import rmse_of, under_amounts_of, under_ratio_of
from jobcast.sources.versions import Versions

METRICS = ("rmse", "mae", "ur", "ur_total_hours", "ur_mean_hours", "ur_std_hours")


def evaluate_results(preds: DataFrame, ceil: bool = False) -> DataFrame:
    """Per trace and target (where the frame has them), window size, model and buffer: mean window metrics, pooled rates and over-prediction totals.

    The predictions are read once: a per-window aggregate carries both the
    window metrics and the counts and sums that the pooled figures add up.
    """
    of = [c for c in ("trace", "target") if c in preds.columns]
    up = F.ceil("pred").cast("double") if ceil else F.col("pred")
    act, req = F.col("act"), F.col("req")
    per_window = preds.groupBy(*of, "window_size", "window_start", "model", "bias").agg(
        rmse_of().alias("rmse"), F.avg(F.abs(act - F.col("pred"))).alias("mae"),
        under_ratio_of().alias("ur"), *under_amounts_of(),
        F.count("*").alias("n"), F.count_if(up < act).alias("n_short"),
        F.sum(F.when(act < req, req - act)).alias("user_over"),
        F.sum(F.when(act < up, up - act)).alias("model_over"),
    )
    share = F.lit(100.0) * F.sum("n_short") / F.sum("n")
    return per_window.groupBy(*of, "window_size", "model", "bias").agg(
        F.count("*").alias("n_windows"),
        *[F.avg(c).alias("avg_" + c) for c in METRICS],
        F.sum("n").alias("n_jobs"), F.sum("n_short").alias("n_under"),
        (F.lit(100.0) - share).alias("success_rate"), share.alias("under_rate"),
        (F.coalesce(F.sum("user_over"), F.lit(0.0)) / 3600.0).alias("user_over_hours"),
        (F.coalesce(F.sum("model_over"), F.lit(0.0)) / 3600.0).alias("model_over_hours"),
    )


def window_partials(preds: DataFrame, ceil: bool = False) -> DataFrame:
    """Counts, sums and sums of squares of each window, model and buffer: what a report needs, and what adds up."""
    of = [c for c in ("trace", "target") if c in preds.columns]
    up = F.ceil("pred").cast("double") if ceil else F.col("pred")
    act, req, off = F.col("act"), F.col("req"), F.col("act") - F.col("pred")
    short = F.when(off > 0, off)
    return preds.groupBy(*of, "window_size", "window_start", "model", "bias").agg(
        F.count("*").alias("n"), F.sum(off * off).alias("off2"), F.sum(F.abs(off)).alias("off"), F.count(short).alias("n_below"),
        F.coalesce(F.sum(short), F.lit(0.0)).alias("below"), F.coalesce(F.sum(short * short), F.lit(0.0)).alias("below2"),
        F.count_if(up < act).alias("n_short"),
        F.coalesce(F.sum(F.when(act < req, req - act)), F.lit(0.0)).alias("user_over"),
        F.coalesce(F.sum(F.when(act < up, up - act)), F.lit(0.0)).alias("model_over"))


def report(partials: DataFrame) -> DataFrame:
    """The report of ``evaluate_results`` from ``window_partials``; partials of the same window add up."""
    of = [c for c in ("trace", "target") if c in partials.columns]
    keys = [*of, "window_size", "window_start", "model", "bias"]
    n, m = F.col("n"), F.col("n_below")
    spread = F.greatest(F.col("below2") - F.col("below") * F.col("below") / m, F.lit(0.0))
    windows = partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in partials.columns if c not in keys]).withColumns({
        "rmse": F.sqrt(F.col("off2") / n), "mae": F.col("off") / n, "ur": F.lit(100.0) * m / n,
        "ur_total_hours": F.col("below") / 3600.0, "ur_mean_hours": F.when(m > 0, F.col("below") / m / 3600.0),
        "ur_std_hours": F.when(m > 1, F.sqrt(spread / (m - 1)) / 3600.0)})
    share = F.lit(100.0) * F.sum("n_short") / F.sum("n")
    return windows.groupBy(*of, "window_size", "model", "bias").agg(
        F.count("*").alias("n_windows"), *[F.avg(c).alias("avg_" + c) for c in METRICS],
        F.sum("n").alias("n_jobs"), F.sum("n_short").alias("n_under"), (F.lit(100.0) - share).alias("success_rate"), share.alias("under_rate"),
        (F.sum("user_over") / 3600.0).alias("user_over_hours"), (F.sum("model_over") / 3600.0).alias("model_over_hours"))


def add_to_report(preds: DataFrame, root: str, ceil: bool = False) -> str:
    """Add the partials of new predictions to the report kept under ``root``; returns the name of this addition.

    An addition counts whole or not at all. Predictions are read once, when they are added; the report reads a row for each window,
    model, buffer and addition. ``ceil`` must be the same in all additions.
    """
    versions = Versions(preds.sparkSession, root)
    added = versions.begin()
    window_partials(preds, ceil).withColumn("ceil", F.lit(ceil)).write.parquet(f"{versions.folder(added)}/partials")
    versions.publish(added)
    return added


def kept_report(spark: SparkSession, root: str) -> DataFrame:
    """The report over everything added under ``root`` so far."""
    versions = Versions(spark, root)
    names = versions.published()
    if not names:
        raise ValueError(f"nothing has been added under {root}")
    partials = spark.read.parquet(*[f"{versions.folder(n)}/partials" for n in names])
    mixed = F.count_if("ceil") * F.count_if(~F.col("ceil")) > 0
    if partials.agg(mixed.alias("mixed")).first()["mixed"]:
        raise ValueError("additions with and without ceil cannot be reported together")
    return report(partials.drop("ceil"))
