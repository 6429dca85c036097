from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import SPEC, jobs, preds, query
from jobcast.functions import filters as P
from jobcast.functions.scalar import inf_to_null
from jobcast.operators.windows import assign_windows_tumbling


@query("filter_success", """
select job_id, exit_state, run_time from jobs where exit_state = 'completed' and run_time is distinct from 0""")
def _success(spark, sf_dir):
    return P.filter_success(jobs(spark, sf_dir), SPEC).select("job_id", "exit_state", "run_time")


@query("filter_failure", """
select job_id, exit_state, run_time from jobs where exit_state = 'failed'""")
def _failure(spark, sf_dir):
    return P.filter_failure(jobs(spark, sf_dir), SPEC).select("job_id", "exit_state", "run_time")


@query("drop_incomplete", """
select job_id, mszl, run_time, freq_req from jobs
where mszl is not null and run_time is not null and not isinf(freq_req)""")
def _complete(spark, sf_dir):
    return P.drop_incomplete(inf_to_null(jobs(spark, sf_dir).select("job_id", "mszl", "run_time", "freq_req")))


@query("filter_underpred", """
select job_id, model, act, round(pred, 6) as pred from preds where pred < act""")
def _under(spark, sf_dir):
    return P.filter_underpred(preds(spark, sf_dir)).select("job_id", "model", "act", F.round("pred", 6).alias("pred"))


@query("filter_overpred", """
select job_id, model, act, round(pred, 6) as pred from preds where act < pred""")
def _over(spark, sf_dir):
    return P.filter_overpred(preds(spark, sf_dir)).select("job_id", "model", "act", F.round("pred", 6).alias("pred"))


@query("filter_user_over", """
select job_id, model, act, req from preds where act < req""")
def _user(spark, sf_dir):
    return P.filter_user_over(preds(spark, sf_dir)).select("job_id", "model", "act", "req")


@query("between_right_inclusive", """
select job_id, model, act from preds where act > 3600 and act <= 21600""")
def _between(spark, sf_dir):
    return P.between_right_inclusive(preds(spark, sf_dir), "act", 3600, 21600).select("job_id", "model", "act")


@query("feature_profile", """
select f as feature, count(*) - count(v) as n_missing, count(*) filter (isinf(v)) as n_infinite,
  count(*) filter (v is not null and not isinf(v)) as n_valid
from (select unnest(['cnumr', 'nnumr', 'elpl', 'mszl', 'freq_req']) as f,
  unnest([cnumr, nnumr, elpl, mszl, freq_req]) as v from jobs) group by f""")
def _profile(spark, sf_dir):
    return P.feature_profile(jobs(spark, sf_dir), SPEC.features)


@query("min_group_size", """
, w as (select job_id, window_start, usr, count(*) over (partition by window_start, usr) as n
  from jobs join windows3 on edt >= window_start and edt < window_end)
select job_id, window_start, usr from w where n >= 2""")
def _groups(spark, sf_dir):
    placed = assign_windows_tumbling(jobs(spark, sf_dir), "edt", 3, "2024-01-01", "2024-01-28")
    return P.min_group_size(placed, ["window_start", "usr"]).select("job_id", "window_start", "usr")
