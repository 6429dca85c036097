"""From raw traces to job tables ready for windows and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobcast.functions.filters import failure_of, filter_success, success_of
from jobcast.functions.scalar import (
    cast_int_columns, parse_timestamps, run_time, select_columns, time_limit_seconds, wait_time)
from jobcast.operators.encode import label_encode, sort_trace
from jobcast.session import store
from jobcast.sources.traces import scan_csv_bz2_trace, scan_parquet_trace
from jobcast.spec import EAGLE, FUGAKU, M100, TraceSpec

# Columns of the public traces that are encoded, kept or cast.
FUGAKU_CATEGORIES = ("jid", "usr", "jnam", "jobenv_req")
EAGLE_CATEGORIES = ("job_id", "user", "account", "partition", "qos", "name", "work_dir", "submit_line")
M100_COLUMNS = (
    "array_job_id", "cpus_alloc_layout", "end_time", "group_id", "job_id", "nodes", "num_cpus",
    "num_nodes", "partition", "priority", "qos", "start_time", "submit_time", "time_limit_sec",
    "user_id", "wait_time", "execution_time")
M100_TIME_FORMAT = "yyyy:MM:dd HH"


def in_order(df: DataFrame, cols: list[str], ordered: bool) -> DataFrame:
    """Frames carry no order of their own: rows are sorted only where the caller wants to see it."""
    return sort_trace(df, cols) if ordered else df


def by_outcome(df: DataFrame, spec: TraceSpec) -> tuple[DataFrame, DataFrame]:
    """Successful and failed jobs from one evaluation of ``df``, written once in a partition each; jobs of other states are left out."""
    marked = df.withColumn("__outcome", F.when(success_of(spec), "success").when(failure_of(spec), "failure"))
    stored = store(marked.where(F.col("__outcome").isNotNull()), "trace", ("__outcome",))
    success, failure = [stored.where(F.col("__outcome") == o).drop("__outcome") for o in ("success", "failure")]
    return success, failure


def preprocess_fugaku(spark: SparkSession, path: str, spec: TraceSpec = FUGAKU,
                      schema: StructType | str | None = None,
                      ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Successful jobs with category codes, and failed jobs as they are; the trace is read once."""
    raw = scan_parquet_trace(spark, path, schema)
    timed = parse_timestamps(raw, [spec.submit, spec.start, spec.end])
    timed = run_time(wait_time(timed, spec.submit, spec.start), spec.start, spec.end)
    success, failure = by_outcome(timed, spec)
    keys = [spec.end, spec.key]
    return in_order(label_encode(success, FUGAKU_CATEGORIES), keys, ordered), in_order(failure, keys, ordered)


def preprocess_m100(spark: SparkSession, path: str, spec: TraceSpec = M100,
                    schema: StructType | str | None = None, ordered: bool = False) -> DataFrame:
    """Successful jobs with times, limits in seconds and integer partition and quality class."""
    raw = scan_parquet_trace(spark, path, schema)
    timed = parse_timestamps(raw, [spec.submit, spec.start, spec.end], M100_TIME_FORMAT)
    timed = run_time(wait_time(timed, spec.submit, spec.start), spec.start, spec.end, spec.run_time)
    limited = time_limit_seconds(timed, "time_limit_str")
    kept = select_columns(filter_success(limited, spec), M100_COLUMNS)
    return in_order(cast_int_columns(kept, ["partition", "qos"]), [spec.start, spec.key], ordered)


def preprocess_eagle(spark: SparkSession, path: str, schema: StructType | str,
                     spec: TraceSpec = EAGLE) -> tuple[DataFrame, DataFrame]:
    """Successful jobs with wait time and category codes, and timed-out jobs as they are; the text is unpacked once."""
    success, failure = by_outcome(scan_csv_bz2_trace(spark, path, schema), spec)
    success = parse_timestamps(success, [spec.start, spec.submit])
    return label_encode(wait_time(success, spec.submit, spec.start), EAGLE_CATEGORIES, as_string=True), failure
