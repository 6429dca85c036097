"""Row filters and feature checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.functions.scalar import finite
from jobcast.operators.scaling import attach
from jobcast.session import store
from jobcast.spec import TraceSpec


def success_of(spec: TraceSpec) -> Column:
    return (F.col(spec.state) == spec.success) & ~F.col(spec.run_time).eqNullSafe(F.lit(0.0))


def failure_of(spec: TraceSpec) -> Column:
    if spec.failure is None:
        raise ValueError(f"trace {spec.name!r} names no failure state")
    return F.col(spec.state) == spec.failure


def filter_success(df: DataFrame, spec: TraceSpec) -> DataFrame:
    """Successful jobs whose run time is not 0; a missing run time is kept."""
    return df.where(success_of(spec))


def filter_failure(df: DataFrame, spec: TraceSpec) -> DataFrame:
    return df.where(failure_of(spec))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=None if subset is None else list(subset))


def filter_underpred(df: DataFrame) -> DataFrame:
    return df.where(F.col("pred") < F.col("act"))


def filter_overpred(df: DataFrame) -> DataFrame:
    return df.where(F.col("act") < F.col("pred"))


def filter_user_over(df: DataFrame) -> DataFrame:
    return df.where(F.col("act") < F.col("req"))


def between_right_inclusive(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(col) > lo) & (F.col(col) <= hi))


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not in the trace: {missing}")
    text = [f for f in features if not isinstance(df.schema[f].dataType, T.NumericType)]
    if text:
        raise ValueError(f"features that are not numeric: {text}")


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing, infinite and usable values of each feature, in one pass over the trace."""
    check_features(df, features)
    counts = []
    for i, f in enumerate(features):
        c = F.col(f).cast("double")
        good = finite(c)
        counts += [
            F.count_if(c.isNull() | F.isnan(c)).alias(f"m{i}"),
            F.count_if(F.abs(c) == F.lit(float("inf"))).alias(f"i{i}"),
            F.count(good).alias(f"v{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("n_missing"),
                 F.col(f"i{i}").alias("n_infinite"), F.col(f"v{i}").alias("n_valid"))
        for i, f in enumerate(features)])
    return df.agg(*counts).select(F.inline(rows))


def min_group_size(df: DataFrame, by: Sequence[str], n: int = 2) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    big = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).drop("__n")
    return attach(df, store(big, "groups"), by, how="left_semi")
