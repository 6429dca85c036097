from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import jobs, query, rounded, window_preds
from jobcast.plans.experiment import as_results
from jobcast.session import fresh_path
from jobcast.sources.predictions import scan_predictions, sink_predictions
from jobcast.sources.traces import scan_csv_bz2_trace, scan_parquet_trace
from jobcast.spec import FUGAKU

EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"


@query("scan_parquet_trace", """
select event_id, ts, event_type, value from events""")
def _parquet(spark, sf_dir):
    return scan_parquet_trace(spark, f"{sf_dir}/events.parquet", EVENTS)


@query("scan_csv_bz2_trace", """
select job_id, usr, exit_state, adt, run_time, elpl, mszl from jobs""")
def _csv(spark, sf_dir):
    path = fresh_path(spark, "trace-csv")
    trace = jobs(spark, sf_dir).select("job_id", "usr", "exit_state", "adt", "run_time", "elpl", "mszl")
    trace.write.option("header", True).option("compression", "bzip2").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return scan_csv_bz2_trace(spark, path, trace.schema)


def stored_predictions(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    grouped = window_preds(spark, sf_dir).withColumn("cluster", (F.col("job_id") % 4).cast("int"))
    sink_predictions(as_results(grouped, FUGAKU), path)
    return path


@query("sink_predictions", """
select job_id, cast(job_id % 4 as int) as cluster, round(pred, 6) as pred, act, req, 'fugaku' as trace, 'duration' as target,
  model, bias, window_size, window_start from window_preds""")
def _sink(spark, sf_dir):
    return rounded(scan_predictions(spark, stored_predictions(spark, sf_dir)))


@query("scan_predictions", """
select model, bias, window_start, count(*) as n_jobs, round(sum(pred), 3) as total_pred from window_preds
where model = 'scaled_actual' and bias = 'two_sigma'
  and window_start in (timestamp '2024-01-01', timestamp '2024-01-16') group by all""")
def _scan(spark, sf_dir):
    chosen = scan_predictions(spark, stored_predictions(spark, sf_dir), ["scaled_actual"], ["two_sigma"],
                              ["2024-01-01", "2024-01-16"])
    return chosen.groupBy("model", "bias", "window_start").agg(
        F.count("*").alias("n_jobs"), F.round(F.sum("pred"), 3).alias("total_pred"))
