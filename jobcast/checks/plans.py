from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.aggregates import METRICS, ROUND_METRICS
from jobcast.checks.registry import FIRST, LAST, finished, jobs, kept, query, rounded, window_preds
from jobcast.checks.training import (
    BIAS_LIST, BUFFER_OF, HALF_MONTHS, LEAVES, LOG_LEAF, ROWS, buffers_sql, trace)
from jobcast.operators.metrics import BIAS_TYPES, apply_bias, group_mean_predictor, underpred_bias, window_metrics
from jobcast.operators.sampling import split_hash
from jobcast.operators.windows import assign_windows_tumbling
from jobcast.plans.evaluate import add_to_report, evaluate_results, kept_report
from jobcast.plans.experiment import experiment_baseline, experiment_grouped
from jobcast.plans.preprocess import preprocess_eagle, preprocess_fugaku, preprocess_m100
from jobcast.plans.swf import to_swf
from jobcast.session import fresh_path, store
from jobcast.spec import FUGAKU

SECOND = "yyyy-MM-dd HH:mm:ss"


def split_windows(spark, sf_dir):
    """Finished jobs in their window, with test and validation flags."""
    placed = assign_windows_tumbling(finished(spark, sf_dir), "edt", 3, FIRST, LAST)
    return split_hash(split_hash(placed, "job_id", 0.2, 33), "job_id", 0.4, 42, "is_val")


def fugaku_trace(df):
    return df.select("jid", "usr", "jnam", "jobenv_req", "adt", "sdt", "edt",
                     F.col("exit_state").alias("exit state"), "cnumr", "nnumr", "elpl", "mszl", "freq_req",
                     "cnumat", "usctmut", "mmszu", F.col("run_time").alias("duration"))


def m100_trace(df):
    hour = lambda c: F.date_format(c, "yyyy:MM:dd HH")
    return df.select(
        F.col("job_id").alias("array_job_id"), F.col("usr").alias("cpus_alloc_layout"),
        hour("edt").alias("end_time"), (F.col("user_id") % 7).alias("group_id"), "job_id",
        F.col("jnam").alias("nodes"), F.col("cnumr").alias("num_cpus"), F.col("nnumr").alias("num_nodes"),
        "partition", F.col("k").alias("priority"), "qos", hour("sdt").alias("start_time"),
        hour("adt").alias("submit_time"), "time_limit_str", "user_id",
        F.upper("exit_state").alias("job_state"))


def eagle_trace(df):
    return df.select(
        "job_id",
        F.when(F.col("exit_state") == "failed", "TIMEOUT").otherwise(F.upper("exit_state")).alias("state"),
        F.col("usr").alias("user"),
        F.when(F.col("k") % 10 != 3, F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string"))).alias("account"),
        "partition", "qos", F.col("jnam").alias("name"), F.concat(F.lit("/home/"), "usr").alias("work_dir"),
        F.concat(F.lit("sbatch, "), "jnam", F.lit(" -n "), F.col("k").cast("string")).alias("submit_line"),
        F.date_format("adt", SECOND).alias("submit_time"), F.date_format("sdt", SECOND).alias("start_time"),
        F.date_format("edt", SECOND).alias("end_time"), "run_time", F.col("elpl").alias("wallclock_req"),
        F.col("cnumr").alias("processors_req"), F.col("mszl").alias("mem_req"), F.col("nnumr").alias("nodes_req"),
        F.col("cnumat").alias("gpus_req"))


@query("preprocess_fugaku", """
, s as (select * from jobs where exit_state = 'completed' and run_time is distinct from 0)
select dense_rank() over (order by jid) - 1 as jid, dense_rank() over (order by usr) - 1 as usr,
  dense_rank() over (order by jnam) - 1 as jnam, dense_rank() over (order by jobenv_req) - 1 as jobenv_req,
  adt, sdt, edt, exit_state, cnumr, nnumr, elpl, mszl, freq_req, cnumat, round(usctmut, 6) as usctmut, mmszu,
  run_time as duration, wait_time, run_time from s""")
def _fugaku(spark, sf_dir):
    path = fresh_path(spark, "trace")
    fugaku_trace(jobs(spark, sf_dir)).write.parquet(path)
    success, _ = preprocess_fugaku(spark, path)
    return success.withColumnRenamed("exit state", "exit_state").withColumn("usctmut", F.round("usctmut", 6))


@query("preprocess_fugaku_failures", """
select jid, usr, jnam, jobenv_req, adt, sdt, edt, exit_state, cnumr, nnumr, elpl, mszl, freq_req, cnumat,
  round(usctmut, 6) as usctmut, mmszu, run_time as duration, wait_time, run_time from jobs where exit_state = 'failed'""")
def _fugaku_failures(spark, sf_dir):
    path = fresh_path(spark, "trace")
    fugaku_trace(jobs(spark, sf_dir)).write.parquet(path)
    _, failure = preprocess_fugaku(spark, path)
    return failure.withColumnRenamed("exit state", "exit_state").withColumn("usctmut", F.round("usctmut", 6))


@query("preprocess_m100", """
, t as (select *, date_trunc('hour', adt) as submit_time, date_trunc('hour', sdt) as start_time,
  date_trunc('hour', edt) as end_time from jobs),
s as (select *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 as execution_time from t)
select job_id as array_job_id, usr as cpus_alloc_layout, end_time, user_id % 7 as group_id, job_id, jnam as nodes,
  cnumr as num_cpus, nnumr as num_nodes, cast(partition as int) as partition, k as priority, cast(qos as int) as qos,
  start_time, submit_time, cast(case job_id % 3 when 2 then elpl % 86400 + 86400 + 1815 else elpl end as bigint)
    as time_limit_sec, user_id, (epoch_us(start_time) - epoch_us(submit_time)) / 1e6 as wait_time, execution_time
from s where exit_state = 'completed' and execution_time is distinct from 0""")
def _m100(spark, sf_dir):
    path = fresh_path(spark, "trace")
    m100_trace(jobs(spark, sf_dir)).write.parquet(path)
    return preprocess_m100(spark, path)


@query("preprocess_eagle", """
, t as (select *, date_trunc('second', adt) as submit, date_trunc('second', sdt) as start,
  case when k % 10 <> 3 then 'a' || (user_id % 5) end as acct from jobs
  where exit_state = 'completed' and run_time is distinct from 0)
select dense_rank() over (order by job_id::varchar) - 1 as job_id, 'COMPLETED' as state,
  dense_rank() over (order by usr) - 1 as user, dense_rank() over (order by coalesce(acct, 'nan')) - 1 as account,
  dense_rank() over (order by partition) - 1 as partition, dense_rank() over (order by qos) - 1 as qos,
  dense_rank() over (order by jnam) - 1 as name, dense_rank() over (order by '/home/' || usr) - 1 as work_dir,
  dense_rank() over (order by 'sbatch, ' || jnam || ' -n ' || k) - 1 as submit_line,
  submit as submit_time, start as start_time, strftime(edt, '%Y-%m-%d %H:%M:%S') as end_time, run_time,
  elpl as wallclock_req, cnumr as processors_req, mszl as mem_req, nnumr as nodes_req, cnumat as gpus_req,
  (epoch_us(start) - epoch_us(submit)) / 1e6 as wait_time from t""")
def _eagle(spark, sf_dir):
    path = fresh_path(spark, "trace")
    trace_rows = eagle_trace(jobs(spark, sf_dir))
    trace_rows.write.option("header", True).option("compression", "bzip2").csv(path)
    success, _ = preprocess_eagle(spark, path, trace_rows.schema)
    return success


@query("preprocess_eagle_failures", """
select job_id, 'TIMEOUT' as state, usr as user, case when k % 10 <> 3 then 'a' || (user_id % 5) end as account, partition, qos,
  jnam as name, '/home/' || usr as work_dir, 'sbatch, ' || jnam || ' -n ' || k as submit_line,
  strftime(adt, '%Y-%m-%d %H:%M:%S') as submit_time, strftime(sdt, '%Y-%m-%d %H:%M:%S') as start_time,
  strftime(edt, '%Y-%m-%d %H:%M:%S') as end_time, run_time, elpl as wallclock_req, cnumr as processors_req,
  mszl as mem_req, nnumr as nodes_req, cnumat as gpus_req from jobs where exit_state = 'failed'""")
def _eagle_failures(spark, sf_dir):
    path = fresh_path(spark, "trace")
    trace_rows = eagle_trace(jobs(spark, sf_dir))
    trace_rows.write.option("header", True).option("compression", "bzip2").csv(path)
    _, failure = preprocess_eagle(spark, path, trace_rows.schema)
    return failure


@query("to_swf", """
, u as (select usr, row_number() over (order by min(row(adt, job_id))) as user_id from jobs group by usr),
a as (select jnam, row_number() over (order by min(row(adt, job_id))) as app_id from jobs group by jnam)
select row_number() over (order by adt, job_id) as job_number,
  cast(floor(epoch_us(adt) / 1000000.0) as bigint) - (select min(cast(floor(epoch_us(adt) / 1000000.0) as bigint)) from jobs)
    as submit_time, coalesce(wait_time, -1) as wait_time, coalesce(run_time, -1) as run_time,
  coalesce(cnumat, -1) as allocated_processors,
  round(coalesce(coalesce(usctmut, 0) / nullif(cnumat, 0), -1), 6) as avg_cpu_time,
  coalesce(mmszu, -1) as used_memory, cnumr as requested_processors, elpl as requested_time,
  coalesce(mszl, -1) as requested_memory,
  case exit_state when 'completed' then 1 when 'failed' then 0 when 'cancelled' then 5 else -1 end as status,
  u.user_id, -1 as group_id, a.app_id as executable_number, -1 as queue_number, -1 as partition_number,
  -1 as preceding_job, -1 as think_time
from jobs join u on u.usr = jobs.usr join a on a.jnam = jobs.jnam""")
def _swf(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    named = rows.withColumnRenamed("exit_state", "exit state")
    return rounded(to_swf(named, FUGAKU.with_(key="job_id")))


def experiment_sql(models: dict[str, str], keys: str) -> str:
    """Predictions of single trees: leaf means per window, frequency and nodes, buffers per ``keys``."""
    leaves = " union all ".join(
        f"select '{m}' as model, window_start, freq_req, nnumr, {leaf} as pred from clean "
        "where not is_test and not is_val group by window_start, freq_req, nnumr" for m, leaf in models.items())
    on = " and ".join(f"b.{c} = s.{c}" for c in keys.split(", "))
    return ROWS.replace("nnumr, cast", "nnumr, freq_req, cast") + f"""
, clean as (select * from rows where not isinf(freq_req)),
leaf as ({leaves}),
scored as (select job_id, c.window_start, c.freq_req, leaf.model, is_test, y, req, pred from clean c join leaf
  on leaf.window_start = c.window_start and leaf.freq_req = c.freq_req and leaf.nnumr = c.nnumr where is_test or is_val)
""" + buffers_sql("(select * from scored where not is_test)", keys) + f"""
select job_id, s.window_start, s.model, t.bias, y as act, req, round(pred + {BUFFER_OF}, 4) as pred,
  'fugaku' as trace, 'run_time' as target, 16 as window_size
from scored s join buffers b on {on} cross join {BIAS_LIST} where is_test"""


@query("experiment_baseline", experiment_sql({"baseline": LOG_LEAF}, "window_start, model"))
def _baseline(spark, sf_dir):
    return rounded(experiment_baseline(trace(spark, sf_dir).drop("mszl", "cnumr"), LEAVES, "one_tree").drop("cluster"), 4)


@query("experiment_grouped", experiment_sql(
    {"clustering_xgb": LOG_LEAF, "clustering_rf": "avg(y)"}, "window_start, freq_req, model"))
def _grouped(spark, sf_dir):
    return rounded(experiment_grouped(trace(spark, sf_dir).drop("mszl", "cnumr"), LEAVES, "one_tree",
                                      ["clustering_xgb", "clustering_rf"]).drop("cluster"), 4)


def jobs_judged_sql(models: list[str]) -> str:
    """What holds whatever the models predict: every complete test job once for each model and buffer, and nothing is missed or invented."""
    names = ", ".join(f"('{m}')" for m in models)
    return ROWS.replace("nnumr, cast", "nnumr, mszl, freq_req, cast") + f"""
, judged as (select window_start from rows where is_test and mszl is not null and not isinf(freq_req))
select m.model, t.bias, 16 as window_size, count(distinct window_start) as n_windows, count(*) as n_jobs
from judged cross join (values {names}) m(model) cross join {BIAS_LIST} group by all"""


def jobs_judged(report):
    return report.select("model", "bias", "window_size", "n_windows", "n_jobs")


@query("experiment_baseline_ensembles", jobs_judged_sql(["baseline"]))
def _baseline_ensembles(spark, sf_dir):
    """Boosted trees on all five features."""
    return jobs_judged(evaluate_results(experiment_baseline(trace(spark, sf_dir), HALF_MONTHS, "fast")))


@query("experiment_grouped_ensembles", jobs_judged_sql(["clustering_xgb", "clustering_rf", "resampled_xgb", "resampled_rf"]))
def _grouped_ensembles(spark, sf_dir):
    """All four variants on all five features."""
    return jobs_judged(evaluate_results(experiment_grouped(trace(spark, sf_dir), HALF_MONTHS, "fast")))


EVALUATED = METRICS + """, pooled as (select window_size, model, bias, count(*) as n_jobs,
  count(*) filter (ceil(pred) < act) as n_under, coalesce(sum(req - act) filter (act < req), 0) / 3600 as u,
  coalesce(sum(ceil(pred) - act) filter (act < ceil(pred)), 0) / 3600 as m from window_preds group by all),
averages as (select window_size, model, bias, count(*) as n_windows, avg(rmse) as rmse, avg(mae) as mae, avg(ur) as ur,
  avg(ur_total_hours) as t, avg(ur_mean_hours) as me, avg(ur_std_hours) as s from wm group by all)
select window_size, model, bias, n_windows, round(rmse, 4) as avg_rmse, round(mae, 4) as avg_mae, round(ur, 4) as avg_ur,
  round(t, 7) as avg_ur_total_hours, round(me, 4) as avg_ur_mean_hours, round(s, 4) as avg_ur_std_hours, n_jobs, n_under,
  round(100 - 100.0::double * n_under / n_jobs, 4) as success_rate, round(100.0::double * n_under / n_jobs, 4) as under_rate,
  round(u, 7) as user_over_hours, round(m, 7) as model_over_hours
from averages join pooled using (window_size, model, bias)"""


@query("evaluate_results", EVALUATED)
def _evaluate(spark, sf_dir):
    return rounded(evaluate_results(window_preds(spark, sf_dir), ceil=True), 4)


@query("evaluate_results_added", EVALUATED)
def _evaluate_added(spark, sf_dir):
    """The same report kept up to date: first the windows of the first half of the month, then the others."""
    preds, root = kept(window_preds(spark, sf_dir)), fresh_path(spark, "report")
    early = F.col("window_start") < F.lit("2024-01-15").cast("timestamp_ntz")
    add_to_report(preds.where(early), root, ceil=True)
    add_to_report(preds.where(~early), root, ceil=True)
    return rounded(kept_report(spark, root), 4)


CHAIN = """
, rows as (select job_id, jnam, run_time, elpl, window_start,
    ('0x' || substr(md5(job_id::varchar || ':33'), 1, 8))::bigint % 10000 < 2000 as is_test,
    ('0x' || substr(md5(job_id::varchar || ':42'), 1, 8))::bigint % 10000 < 4000 as is_val
  from finished join windows3 on edt >= window_start and edt < window_end),
means as (select window_start, jnam, avg(run_time) as pred from rows where not is_test and not is_val group by all),
short as (select rows.window_start, rows.jnam, case when run_time > pred then run_time - pred end as s
  from rows join means on means.window_start = rows.window_start and means.jnam = rows.jnam where not is_test and is_val),
mid as (select window_start, jnam, median(s) as med from short group by all),
buffers as (select short.window_start, short.jnam, avg(s) as mean, median(abs(s - med)) as mad, stddev_pop(s) as std_dev
  from short join mid on mid.window_start = short.window_start and mid.jnam = short.jnam group by all),
window_preds2 as (select rows.window_start, 3 as window_size, 'group_mean' as model, t.bias, run_time as act, elpl as req,
  pred + coalesce(case t.bias when 'none' then 0 when 'mean' then b.mean when 'mad' then b.mad
    when 'std_dev' then b.std_dev else 2 * b.std_dev end, 0) as pred
  from rows join means on means.window_start = rows.window_start and means.jnam = rows.jnam
  left join buffers b on b.window_start = rows.window_start and b.jnam = rows.jnam
  cross join (values ('none'), ('mean'), ('mad'), ('std_dev'), ('two_sigma')) t(bias) where is_test)
"""


@query("group_mean_experiment", CHAIN + METRICS.replace("window_preds", "window_preds2")
       + f"select window_size, window_start, model, bias, {ROUND_METRICS} from wm")
def group_mean_experiment(spark, sf_dir):
    """How often would each buffer have killed the job? The whole chain with the group mean as its model."""
    by = ["window_start", "jnam"]
    rows = store(split_windows(spark, sf_dir).select(
        "job_id", *by, "run_time", F.col("elpl").alias("req"), "is_test", "is_val"), "split-jobs")
    fits = rows.where(~F.col("is_test") & ~F.col("is_val"))
    scored = store(group_mean_predictor(fits, rows.where("is_test or is_val"), "run_time", by).select(
        *by, "is_test", F.lit(3).alias("window_size"), F.lit("group_mean").alias("model"), "act", "req", "pred"), "scored")
    biases = underpred_bias(scored.where(~F.col("is_test")), by)
    return rounded(window_metrics(apply_bias(scored.where("is_test"), biases, BIAS_TYPES, by)), 4)
