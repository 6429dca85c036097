"""Export to the Standard Workload Format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.functions.scalar import epoch_relative_submit, fill_missing, safe_ratio, status_code_map
from jobcast.operators.encode import first_seen_id, sequential_job_number
from jobcast.spec import FUGAKU, TraceSpec

# The 18 fields in the order of the format, and those without information.
SWF_COLUMNS = (
    "job_number", "submit_time", "wait_time", "run_time", "allocated_processors", "avg_cpu_time",
    "used_memory", "requested_processors", "requested_time", "requested_memory", "status", "user_id",
    "group_id", "executable_number", "queue_number", "partition_number", "preceding_job", "think_time")
SWF_UNKNOWN = ("group_id", "queue_number", "partition_number", "preceding_job", "think_time")
SWF_SOURCES = {
    "wait_time": "wait_time", "run_time": "run_time", "allocated_processors": "cnumat",
    "used_memory": "mmszu", "requested_processors": "cnumr", "requested_time": "elpl",
    "requested_memory": "mszl"}


def to_swf(df: DataFrame, spec: TraceSpec = FUGAKU, strict_case: bool = False) -> DataFrame:
    """One row per job with the 18 fields of the format; -1 stands for unknown."""
    order = [spec.submit, spec.key]
    needed = df.select(spec.key, spec.submit, F.col(spec.state).alias("__state"), "usr", "jnam", "usctmut",
                       *[F.col(src).cast("double").alias(src) for src in SWF_SOURCES.values()])
    numbered = epoch_relative_submit(sequential_job_number(needed, order), spec.submit, out="submit_time")
    numbered = first_seen_id(numbered, "usr", ["job_number"], "user_id")
    numbered = first_seen_id(numbered, "jnam", ["job_number"], "executable_number")
    rated = safe_ratio(numbered, "usctmut", "cnumat", out="avg_cpu_time")
    coded = status_code_map(rated, "__state", strict_case=strict_case)
    renamed = coded.withColumns({out: F.col(src) for out, src in SWF_SOURCES.items()})
    filled = fill_missing(renamed, {c: -1 for c in SWF_SOURCES})
    return filled.withColumns({c: F.lit(-1) for c in SWF_UNKNOWN}).select(*SWF_COLUMNS)
