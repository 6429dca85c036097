"""Display labels for models, buffers and duration ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names of the model and buffer pairs.
MODEL_BIAS_NAMES = {
    "baseline - none": "Single-XGB",
    "baseline - two_sigma": "Single-XGB + 2σ",
    "clustering_xgb - none": "Clustering-XGB",
    "clustering_xgb - two_sigma": "Clustering-XGB + 2σ",
    "clustering_rf - none": "Clustering-RF",
    "clustering_rf - two_sigma": "Clustering-RF + 2σ",
    "resampled_xgb - none": "Resampling-XGB",
    "resampled_xgb - two_sigma": "Resampling-XGB + 2σ",
    "resampled_rf - none": "Resampling-RF",
    "resampled_rf - two_sigma": "Resampling-RF + 2σ",
}


def model_bias_label(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """``model - bias`` and its display name; pairs without a name keep the key."""
    chosen = MODEL_BIAS_NAMES if names is None else names
    key = F.concat_ws(" - ", "model", "bias")
    pairs = [F.lit(x) for item in chosen.items() for x in item]
    shown = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key
    return df.withColumns({"model_bias": key, "label": shown})


def duration_text(c: Column) -> Column:
    """Whole minutes below an hour, whole hours below a day, days beyond."""
    def whole(unit: int, letter: str) -> Column:
        return F.concat(F.floor(c / F.lit(unit)).cast("string"), F.lit(letter))
    return F.when(c < 3600, whole(60, "m")).when(c < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def format_bounds_label(df: DataFrame, lo: str, hi: str, out: str = "bounds_label") -> DataFrame:
    return df.withColumn(out, F.concat(
        F.lit("("), duration_text(F.col(lo)), F.lit(", "), duration_text(F.col(hi)), F.lit("]")))


def format_error_label(df: DataFrame, minutes: str, out: str = "error_label") -> DataFrame:
    """Minutes with one digit, or hours above 60 minutes."""
    m = F.col(minutes)
    return df.withColumn(out, F.when(m > 60, F.format_string("%.1f hours", m / 60.0)).otherwise(
        F.format_string("%.1f minutes", m)))
