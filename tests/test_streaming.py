import pytest
from pyspark.sql import functions as F

from jobcast.operators.windows import assign_windows_sliding, window_table
from jobcast.session import fresh_path
from jobcast.plans.models import ModelWriter
from jobcast.plans.train import train_variants
from jobcast.sources.versions import Versions
from jobcast.streaming.jobs import Serving, run_available, stream_suggest, stream_window_stats


def test_late_rows_are_dropped_and_closed_windows_equal_the_batch(spark):
    path = fresh_path(spark, "stream-in")
    schema = "i long, t timestamp_ntz, wait_time double, run_time double"

    def write(sql):
        spark.sql(sql).coalesce(1).write.mode("append").parquet(path)

    write("""select id i, timestamp_ntz'2024-01-01' + make_dt_interval(0, id) t, double(id) wait_time,
        double(id * 2) run_time from range(240)""")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = fresh_path(spark, "stream-state")
    stats = stream_window_stats(stream, "t", "3 days", "1 day", "6 hours")

    def run():
        q = (stats.writeStream.outputMode("append").format("parquet").option("path", root + "/out")
             .option("checkpointLocation", root + "/state").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    write("select 9999L i, timestamp_ntz'2024-01-02' t, 1e9D wait_time, 1e9D run_time")  # far too late
    run()
    got = {r["window_start"]: tuple(r)[2:] for r in spark.read.schema(stats.schema).parquet(root + "/out").collect()}
    batch = spark.read.schema(schema).parquet(path).where("i < 9999")
    windows = window_table(spark, "2023-12-30", "2024-01-10", 3, "1D")
    want = assign_windows_sliding(batch, windows, "t").groupBy("window_start", "window_end").agg(
        F.count("*").alias("n"), F.avg("wait_time").alias("w"), F.avg("run_time").alias("r")).where(
        "window_end <= timestamp_ntz'2024-01-10 23:00:00' - interval 6 hours")
    assert got == {r["window_start"]: (r["n"], r["w"], r["r"]) for r in want.collect()}
    assert len(got) == 9  # ends from 2 to 10 January


def test_unknown_bias():
    with pytest.raises(ValueError):
        Serving(None, "x", "sigma")


def test_nothing_published(spark):
    with pytest.raises(ValueError, match="published"):
        Serving(spark, fresh_path(spark, "models"), "none").refresh()


def trained(spark, root, factor, windows=("2024-01-01",)):
    """Run times of 100 times the nodes in one queue and 1000 times in the other, times ``factor``."""
    rows = spark.range(400).selectExpr(
        "id as job_id", "double(1 + id % 5) as nodes", "double(id % 2 * 1000) as queue",
        f"(1 + id % 5) * if(id % 2 = 0, 100, 1000) * {factor}D as y")
    rows = rows.crossJoin(spark.createDataFrame([(w,) for w in windows], "w string")).selectExpr("*", "to_timestamp_ntz(w) as window_start").drop("w")
    centers = spark.createDataFrame([(w, i, [3.0, 1000.0 * i]) for w in windows for i in (0, 1)], "w string, cluster int, center array<double>")
    centers = centers.selectExpr("to_timestamp_ntz(w) as window_start", "cluster", "center")
    return train_variants(rows, ["nodes", "queue"], "y", ["clustering_rf"], "one_tree", centers=centers, root=root)


def test_service_goes_on_while_models_change(spark):
    """A version published between two batches answers the second; one not yet published answers none."""
    root, path, sink = [fresh_path(spark, n) for n in ("models", "jobs", "sink")]
    trained(spark, root, 1, ["2024-01-01", "2024-02-01"])

    def submit(first):
        spark.range(first, first + 10).selectExpr("id as job_id", "double(1 + id % 5) as nodes", "double(id % 2 * 1000) as queue").coalesce(1).write.mode("append").parquet(path)

    submit(0)
    stream = spark.readStream.schema("job_id long, nodes double, queue double").parquet(path)
    query = stream_suggest(stream, root, "none", sink, trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        unseen = ModelWriter(spark, root)  # a training that has not ended
        spark.range(1).write.parquet(unseen.versions.folder(unseen.version) + "/manifest")
        submit(10)
        query.processAllAvailable()
        trained(spark, root, 7, ["2024-03-01"])
        submit(20)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.schema("job_id long, cluster int, model string, suggested double, version string").parquet(sink + "/out").collect()
    assert {r.job_id: r.suggested for r in got} == {i: (1 + i % 5) * (100 if i % 2 == 0 else 1000) * (7.0 if i >= 20 else 1.0) for i in range(30)}
    assert all(r.cluster == r.job_id % 2 for r in got)
    assert sorted({r.version for r in got}) == Versions(spark, root).published() and len({r.version for r in got if r.job_id < 20}) == 1


def test_service_of_a_named_window(spark):
    root = fresh_path(spark, "models")
    trained(spark, root, 1, ["2024-01-01", "2024-02-01"])
    serving = Serving(spark, root, "none", "2024-01-01 00:00:00")
    serving.refresh()
    assert len(serving.models) == 2 and {str(g[0]) for g in serving.models} == {"2024-01-01 00:00:00"}
    with pytest.raises(ValueError, match="window"):
        Serving(spark, root, "none", "2023-01-01 00:00:00").refresh()


def test_run_available_on_pass_through(spark):
    path = fresh_path(spark, "stream-in")
    spark.range(5).write.parquet(path)
    assert run_available(spark.readStream.schema("id long").parquet(path), spark, "copy").count() == 5
