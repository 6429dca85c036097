from __future__ import annotations

from jobcast.checks.registry import finished, jobs_of, kept, query, rounded
from jobcast.checks.training import LEAVES, LOG_LEAF, ROWS, buffers_sql, trace
from jobcast.functions.scalar import inf_to_null
from jobcast.operators.cluster import kmeans_group_jobs
from jobcast.operators.dictionary import encode_with, grow_dictionary
from jobcast.plans.train import train_variants
from jobcast.session import fresh_path
from jobcast.streaming.jobs import run_available, stream_suggest, stream_window_stats

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def job_stream(spark, sf_dir):
    # A file stream takes a folder or a pattern, not the name of a single file.
    return jobs_of(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/[e]vents.parquet"))


@query("stream_window_stats", """
, w as (select unnest(generate_series(timestamp '2023-12-26', (select max(edt) from jobs), interval 3 day)) as ws)
select ws as window_start, ws + interval 9 day as window_end, count(*) as n_jobs,
  round(avg(wait_time), 6) as mean_wait, round(avg(run_time), 6) as mean_run
from jobs join w on edt >= ws and edt < ws + interval 9 day group by ws
having ws + interval 9 day <= (select max(edt) from jobs) - interval 1 day""")
def _stats(spark, sf_dir):
    stats = stream_window_stats(job_stream(spark, sf_dir), "edt", "9 days", "3 days", "1 day", "1 day")
    return rounded(run_available(stats, spark, "window-stats"))


@query("stream_suggest", ROWS.replace("nnumr, cast", "jnam, freq_req, cast") + f"""
, clean as (select * from rows where not isinf(freq_req)),
leaf as (select freq_req, jnam, {LOG_LEAF} as pred from clean where not is_val group by all),
scored as (select clean.freq_req, 'clustering_xgb' as model, y, pred from clean join leaf
  on leaf.freq_req = clean.freq_req and leaf.jnam = clean.jnam where is_val)
""" + buffers_sql("scored", "freq_req, model") + """
, known as (select job_id, freq_req, case when jnam in (select jnam from finished) then jnam
    else (select min(jnam) from finished) end as jnam from jobs)
select job_id, 'clustering_xgb' as model, round(pred + two_sigma, 4) as suggested from known
  join leaf on leaf.freq_req = known.freq_req and leaf.jnam = known.jnam
  join buffers on buffers.freq_req = known.freq_req""")
def _suggest(spark, sf_dir):
    """Train on the finished jobs' codes, then suggest a request for every submitted job from its raw columns.

    A name that no finished job has is -1 to the trees and falls where the first name does.
    """
    features = ["jnam", "freq_req"]
    rows = kept(inf_to_null(trace(spark, sf_dir).select("job_id", "run_time", "freq_req").join(
        finished(spark, sf_dir).select("job_id", "jnam"), "job_id")).na.drop("any"))
    codes, models, sink = [fresh_path(spark, name) for name in ("dictionary", "model-store", "suggestions")]
    grow_dictionary(rows, ["jnam"], codes)
    coded = encode_with(rows, ["jnam"], codes)
    _, fitted = kmeans_group_jobs(coded, features, LEAVES.clusters)
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], "cluster int, center array<double>")
    train_variants(coded, features, "run_time", ["clustering_xgb"], "reference", by=["cluster"], centers=centers, root=models)
    stream_suggest(job_stream(spark, sf_dir), models, "two_sigma", sink, dictionary=codes, categories=["jnam"]).awaitTermination()
    kept_rows = spark.read.schema("job_id long, model string, suggested double").parquet(sink + "/out")
    return rounded(kept_rows.drop("batch"), 4)
