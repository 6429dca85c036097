"""What a user does with each trace: read, preprocess, run the experiments, evaluate."""

import pytest
from pyspark.sql import functions as F

from jobcast import (
    EAGLE, FUGAKU, M100, evaluate_results, experiment_baseline, experiment_grouped, preprocess_eagle,
    preprocess_fugaku, preprocess_m100, run_time, to_swf, wait_time)
from jobcast.checks.plans import eagle_trace, fugaku_trace, m100_trace
from jobcast.checks.registry import jobs
from jobcast.session import drop_stored, fresh_path, store

SHORT = {"first_window": "2024-01-01", "last_window": "2024-01-17", "window_days": 16, "window_step": "16D",
         "clusters": 2, "biases": ("none", "two_sigma")}


def success_of(spark, sf_dir, name):
    trace = jobs(spark, sf_dir)
    path = fresh_path(spark, "flow")
    if name == "fugaku":
        fugaku_trace(trace).write.parquet(path)
        success, failure = preprocess_fugaku(spark, path, ordered=True)
        assert failure.count() == trace.where("exit_state = 'failed'").count()
        ends = [r["edt"] for r in success.select("edt").collect() if r["edt"]]
        assert ends == sorted(ends)
        return success
    if name == "m100":
        m100_trace(trace).write.parquet(path)
        return preprocess_m100(spark, path)
    rows = eagle_trace(trace)
    rows.write.option("header", True).option("compression", "bzip2").csv(path)
    return preprocess_eagle(spark, path, rows.schema)[0]


@pytest.mark.parametrize("spec", [FUGAKU, M100, EAGLE], ids=lambda s: s.name)
def test_trace_to_report(spark, sf_dir, spec):
    spec = spec.with_(**SHORT)
    success = store(success_of(spark, sf_dir, spec.name), "flow")
    baseline = experiment_baseline(success, spec, "one_tree")
    grouped = experiment_grouped(success, spec, "one_tree", ["clustering_rf"])
    report = evaluate_results(grouped.unionByName(baseline)).collect()
    assert {(r["model"], r["bias"]) for r in report} == {
        (m, b) for m in ("baseline", "clustering_rf") for b in spec.biases}
    for r in report:
        assert r["n_windows"] == 2 and r["n_jobs"] > 0 and 0 <= r["success_rate"] <= 100
    assert baseline.where(F.col("req").isNull() | F.col("act").isNull()).count() == 0
    assert baseline.select("trace").distinct().first()["trace"] == spec.name


def test_workload_format_of_raw_trace(spark, sf_dir):
    trace = run_time(wait_time(fugaku_trace(jobs(spark, sf_dir)), "adt", "sdt"), "sdt", "edt")
    swf = to_swf(trace)
    assert len(swf.columns) == 18 and swf.agg(F.max("job_number")).first()[0] == swf.count()


def test_stored_tables_can_be_dropped(spark):
    kept = store(spark.range(3), "gone")
    assert kept.count() == 3
    other = spark.newSession()
    assert other.sparkContext.applicationId == spark.sparkContext.applicationId
    path = kept.inputFiles()[0]
    drop_stored(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
