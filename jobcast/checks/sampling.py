from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import FIRST, LAST, SPEC, finished, jobs, kept, preds, query, rounded
from jobcast.operators import sampling as R
from jobcast.operators.windows import assign_windows_tumbling, nearest_center
from jobcast.checks.windows import CENTER_VIEW, CENTERS


def hash32(seed: int, key: str = "job_id") -> str:
    return f"('0x' || substr(md5({key}::varchar || ':{seed}'), 1, 8))::bigint"


BINNED = """, lim as (select job_id, jnam, run_time as v, min(run_time) over (partition by jnam) as lo,
  max(run_time) over (partition by jnam) as hi from finished),
binned as (select job_id, jnam, v as run_time, case when v = hi then 10
  else least(cast(floor((v - lo) * 10 / (hi - lo)) as int), 9) end as bin from lim)
"""


@query("concat_frames", """
select job_id, model, act, round(pred, 6) as pred from preds where pred < act
union all select job_id, model, act, round(pred, 6) as pred from preds where act < pred""")
def _concat(spark, sf_dir):
    rows = preds(spark, sf_dir).select("job_id", "model", "act", "pred")
    return rounded(R.concat_frames(rows.where("pred < act"), rows.where("act < pred")))


@query("split_success_failure", """
select job_id, exit_state, run_time, case when exit_state = 'failed' then 'failure' else 'success' end as outcome
from jobs where exit_state = 'failed' or (exit_state = 'completed' and run_time is distinct from 0)""")
def _outcome(spark, sf_dir):
    return R.split_success_failure(jobs(spark, sf_dir), SPEC).select("job_id", "exit_state", "run_time", "outcome")


@query("split_by_cluster", CENTER_VIEW + "select job_id, cluster from placed where cluster = 2")
def _cluster(spark, sf_dir):
    placed = nearest_center(jobs(spark, sf_dir), ["cnumr", "elpl"], CENTERS)
    return R.split_by_cluster(placed, 2).select("job_id", "cluster")


@query("split_hash", f"""
select job_id, {hash32(33)} % 10000 < 2000 as is_test, {hash32(42)} % 10000 < 4000 as is_val from jobs""")
def _hash(spark, sf_dir):
    first = R.split_hash(jobs(spark, sf_dir).select("job_id"), "job_id", 0.2, 33)
    return R.split_hash(first, "job_id", 0.4, 42, "is_val")


@query("split_exact", f"""
, w as (select job_id, window_start, row_number() over (partition by window_start order by {hash32(33)}, job_id) as r,
  count(*) over (partition by window_start) as n
  from jobs join windows3 on edt >= window_start and edt < window_end)
select job_id, window_start, r <= ceil(0.2::double * n) as is_test from w""")
def _exact(spark, sf_dir):
    placed = assign_windows_tumbling(jobs(spark, sf_dir), "edt", 3, FIRST, LAST).select("job_id", "window_start")
    return R.split_exact(kept(placed), "job_id", ["window_start"], 0.2, 33)


@query("equal_width_bins", BINNED + "select job_id, jnam, run_time, bin from binned")
def _bins(spark, sf_dir):
    return R.equal_width_bins(finished(spark, sf_dir).select("job_id", "jnam", "run_time"), "run_time", ["jnam"])


@query("balanced_resample", BINNED + f"""
, numbered as (select *, row_number() over (partition by jnam, bin order by {hash32(42)}, job_id) as r from binned),
sizes as (select jnam, bin, count(*) as n, max(count(*)) over (partition by jnam) as most from binned group by jnam, bin),
draws as (select *, unnest(generate_series(1, most)) as draw from sizes),
picks as (select *, ('0x' || substr(md5(concat_ws(':', jnam, bin, draw, '42')), 1, 12))::bigint % n + 1 as pick from draws)
select n.job_id, n.jnam, n.run_time, n.bin, p.draw from picks p
join numbered n on n.jnam = p.jnam and n.bin = p.bin and n.r = p.pick""")
def _balanced(spark, sf_dir):
    rows = kept(finished(spark, sf_dir).select("job_id", "jnam", "run_time"))
    return R.balanced_resample(rows, "run_time", ["jnam"], "job_id")


@query("balance_weights", BINNED + """
, sizes as (select jnam, bin, count(*) as n, max(count(*)) over (partition by jnam) as most from binned group by jnam, bin)
select job_id, jnam, run_time, bin, round(most / n, 6) as weight from binned join sizes using (jnam, bin)""")
def _weights(spark, sf_dir):
    rows = kept(finished(spark, sf_dir).select("job_id", "jnam", "run_time"))
    return R.balance_weights(rows, "run_time", ["jnam"]).withColumn("weight", F.round("weight", 6))
