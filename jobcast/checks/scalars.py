from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import jobs, preds, query, rounded, window_preds
from jobcast.functions import labels as L
from jobcast.functions import scalar as S
from jobcast.plans.preprocess import M100_COLUMNS

EPOCH_SECONDS = "cast(floor(epoch_us(adt) / 1000000.0) as bigint)"


@query("parse_timestamps", """
select job_id, strptime(strftime(adt, '%Y:%m:%d %H'), '%Y:%m:%d %H') as by_hour,
  date_trunc('second', adt) as to_second,
  case when job_id % 10 = 3 then null else date_trunc('second', sdt) end as coerced from jobs""")
def _parse(spark, sf_dir):
    second = "yyyy-MM-dd HH:mm:ss"
    text = jobs(spark, sf_dir).select(
        "job_id", F.date_format("adt", "yyyy:MM:dd HH").alias("by_hour"),
        F.date_format("adt", second).alias("to_second"),
        F.when(F.col("job_id") % 10 == 3, "not a time").otherwise(F.date_format("sdt", second)).alias("coerced"))
    parsed = S.parse_timestamps(text, ["by_hour"], "yyyy:MM:dd HH")
    parsed = S.parse_timestamps(parsed, ["to_second"])
    return S.parse_timestamps(parsed, ["coerced"], second, errors="coerce")


@query("strip_timezone", """
select job_id, adt - interval 9 hour as adt, sdt from jobs""")
def _strip(spark, sf_dir):
    local = jobs(spark, sf_dir).select("job_id", "adt", S.instant_utc(F.col("sdt")).alias("sdt"))
    return S.strip_timezone(S.strip_timezone(local, ["adt"], "Asia/Tokyo"), ["sdt"])


@query("wait_time", """
select job_id, epoch_us(sdt) / 1e6 - epoch_us(adt) / 1e6 as waited, wait_time from
  (select job_id, date_trunc('second', sdt) as sdt, date_trunc('second', adt) as adt, wait_time from jobs)""")
def _wait(spark, sf_dir):
    timed = jobs(spark, sf_dir).select(
        "job_id", F.date_trunc("second", "sdt").cast("timestamp_ntz").alias("sdt"),
        F.date_trunc("second", "adt").cast("timestamp_ntz").alias("adt"), "wait_time")
    return S.wait_time(timed, "adt", "sdt", "waited").select("job_id", "waited", "wait_time")


@query("run_time", """
select job_id, (epoch_us(edt) - epoch_us(sdt)) / 1e6 as run_time from jobs""")
def _run(spark, sf_dir):
    return S.run_time(jobs(spark, sf_dir).select("job_id", "sdt", "edt"), "sdt", "edt").select(
        "job_id", "run_time")


@query("time_limit_seconds", """
select job_id, time_limit_str, cast(elpl as bigint) % (24 * 3600) * (case job_id % 3 when 2 then 1 else 0 end)
  + (case job_id % 3 when 2 then 86400 + 30 * 60 + 15 else cast(elpl as bigint) end) as time_limit_sec from jobs""")
def _limit(spark, sf_dir):
    return S.time_limit_seconds(jobs(spark, sf_dir).select("job_id", "time_limit_str"), "time_limit_str")


@query("epoch_relative_submit", f"""
select job_id, {EPOCH_SECONDS} - (select min({EPOCH_SECONDS}) from jobs) as submit_time from jobs""")
def _epoch(spark, sf_dir):
    return S.epoch_relative_submit(jobs(spark, sf_dir), "adt").select("job_id", "submit_time")


@query("select_columns", """
select job_id as array_job_id, usr as cpus_alloc_layout, edt as end_time, user_id % 7 as group_id, job_id,
  jnam as nodes, cnumr as num_cpus, nnumr as num_nodes, partition, k as priority, qos, sdt as start_time,
  adt as submit_time, elpl as time_limit_sec, user_id, wait_time, run_time as execution_time from jobs""")
def _select(spark, sf_dir):
    named = jobs(spark, sf_dir).withColumns({
        "array_job_id": F.col("job_id"), "cpus_alloc_layout": F.col("usr"), "end_time": F.col("edt"),
        "group_id": F.col("user_id") % 7, "nodes": F.col("jnam"), "num_cpus": F.col("cnumr"),
        "num_nodes": F.col("nnumr"), "priority": F.col("k"), "start_time": F.col("sdt"),
        "submit_time": F.col("adt"), "time_limit_sec": F.col("elpl"), "execution_time": F.col("run_time")})
    return S.select_columns(named, M100_COLUMNS)


@query("cast_int_columns", """
select job_id, cast(partition as int) as partition, cast(qos as int) as qos from jobs""")
def _ints(spark, sf_dir):
    return S.cast_int_columns(jobs(spark, sf_dir).select("job_id", "partition", "qos"), ["partition", "qos"])


@query("to_numeric_coerce", """
select job_id, case when job_id % 11 = 4 then null else elpl end as wallclock_req, run_time from jobs""")
def _numeric(spark, sf_dir):
    text = jobs(spark, sf_dir).select(
        "job_id", F.when(F.col("job_id") % 11 == 4, "unlimited").otherwise(
            F.col("elpl").cast("string")).alias("wallclock_req"), F.col("run_time").cast("string").alias("run_time"))
    return S.to_numeric_coerce(text, ["wallclock_req", "run_time"])


@query("inf_to_null", """
select job_id, case when not isinf(freq_req) then freq_req end as freq_req, mszl, run_time from jobs""")
def _inf(spark, sf_dir):
    return S.inf_to_null(jobs(spark, sf_dir).select("job_id", "freq_req", "mszl", "run_time"))


@query("fill_missing", """
select job_id, coalesce(run_time, -1) as run_time, coalesce(mszl, -1) as mszl, coalesce(usctmut, 0) as usctmut
from jobs""")
def _fill(spark, sf_dir):
    return S.fill_missing(jobs(spark, sf_dir).select("job_id", "run_time", "mszl", "usctmut"),
                          {"run_time": -1, "mszl": -1, "usctmut": 0})


@query("safe_ratio", """
select job_id, round(coalesce(coalesce(usctmut, 0) / nullif(cnumat, 0), -1), 6) as ratio from jobs""")
def _ratio(spark, sf_dir):
    return rounded(S.safe_ratio(jobs(spark, sf_dir), "usctmut", "cnumat").select("job_id", "ratio"))


@query("log_target", """
select job_id, run_time, case when run_time > 0 then round(ln(run_time), 6) end as log_run_time,
  case when run_time > 0 then round(exp(ln(run_time)), 4) end as pred from jobs""")
def _log(spark, sf_dir):
    logged = S.log_target(jobs(spark, sf_dir).select("job_id", "run_time"), "run_time")
    back = S.exp_prediction(logged.withColumn("pred", F.col("log_run_time")))
    return back.withColumns({"log_run_time": F.round("log_run_time", 6), "pred": F.round("pred", 4)})


@query("ceil_prediction", """
select job_id, model, case when job_id % 17 != 0 then ceil(pred / 7) end as pred from preds""")
def _ceil(spark, sf_dir):
    some = preds(spark, sf_dir).select(
        "job_id", "model", F.when(F.col("job_id") % 17 != 0, F.col("pred") / 7).alias("pred"))
    return S.ceil_prediction(some)


@query("overestimation_factor", """
select job_id, model, round(pred / act, 6) as overestimation_factor,
  round(req / act, 6) as user_overestimation_factor from preds""")
def _factor(spark, sf_dir):
    return rounded(S.overestimation_factor(preds(spark, sf_dir)).select(
        "job_id", "model", "overestimation_factor", "user_overestimation_factor"))


@query("signed_abs_error", """
select job_id, model, round(act - pred, 6) as error, round(abs(act - pred) / 60, 6) as abs_error from preds""")
def _error(spark, sf_dir):
    return rounded(S.signed_abs_error(preds(spark, sf_dir)).select("job_id", "model", "error", "abs_error"))


@query("hours_minutes_units", """
select job_id, elpl / 60 as wallclock_req_min, round(wait_time / 3600, 6) as wait_hours from jobs""")
def _units(spark, sf_dir):
    return rounded(S.hours_minutes_units(jobs(spark, sf_dir).select("job_id", "elpl", "wait_time"), {
        "wallclock_req_min": ("elpl", 60), "wait_hours": ("wait_time", 3600)}).drop("elpl", "wait_time"))


@query("model_bias_label", """
select model || ' - ' || bias as model_bias, case model || ' - ' || bias
    when 'request_half - none' then 'Half request' when 'scaled_actual - two_sigma' then 'Scaled + 2σ'
    else model || ' - ' || bias end as label, count(*) as n_jobs from window_preds group by all""")
def _label(spark, sf_dir):
    names = {"request_half - none": "Half request", "scaled_actual - two_sigma": "Scaled + 2σ"}
    return L.model_bias_label(window_preds(spark, sf_dir), names).groupBy("model_bias", "label").agg(
        F.count("*").alias("n_jobs"))


@query("format_bounds_label", """
select job_id, '(' || case when lo < 3600 then cast(floor(lo / 60) as bigint) || 'm' when lo < 86400
    then cast(floor(lo / 3600) as bigint) || 'h' else cast(floor(lo / 86400) as bigint) || 'd' end || ', ' ||
  case when hi < 3600 then cast(floor(hi / 60) as bigint) || 'm' when hi < 86400
    then cast(floor(hi / 3600) as bigint) || 'h' else cast(floor(hi / 86400) as bigint) || 'd' end || ']' as bounds_label
from (select job_id, wait_time as lo, wait_time + elpl * 2 as hi from jobs)""")
def _bounds(spark, sf_dir):
    ranges = jobs(spark, sf_dir).select("job_id", F.col("wait_time").alias("lo"),
                                        (F.col("wait_time") + F.col("elpl") * 2).alias("hi"))
    return L.format_bounds_label(ranges, "lo", "hi").select("job_id", "bounds_label")


@query("status_code_map", """
select job_id, case exit_state when 'completed' then 1 when 'failed' then 0 when 'cancelled' then 5 else -1 end
  as status, case exit_state when 'completed' then 1 else -1 end as strict_status from jobs""")
def _status(spark, sf_dir):
    coded = S.status_code_map(jobs(spark, sf_dir).select("job_id", "exit_state"), "exit_state")
    return S.status_code_map(coded, "exit_state", strict_case=True, out="strict_status").drop("exit_state")
