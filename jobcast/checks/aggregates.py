from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import SPEC, jobs, kept, preds, query, rounded, window_preds
from jobcast.checks.windows import CENTER_VIEW, CENTERS
from jobcast.functions.labels import format_bounds_label, format_error_label
from jobcast.functions.scalar import hours_minutes_units, overestimation_factor
from jobcast.operators import metrics as M
from jobcast.operators.quantiles import exact_quantile
from jobcast.operators.cluster import kmeans_wcss
from jobcast.operators.sampling import equal_width_bins
from jobcast.operators.windows import assign_windows_tumbling

KEYS = "window_size, window_start, model, bias"
METRICS = """, wm as (select window_size, window_start, model, bias,
  sqrt(avg((act - pred) * (act - pred))) as rmse, avg(abs(act - pred)) as mae,
  100.0::double * count(*) filter (pred < act) / count(*) as ur,
  coalesce(sum(act - pred) filter (pred < act), 0) / 3600 as ur_total_hours,
  avg(act - pred) filter (pred < act) / 3600 as ur_mean_hours,
  stddev_samp(act - pred) filter (pred < act) / 3600 as ur_std_hours
  from window_preds group by window_size, window_start, model, bias)
"""
ROUND_METRICS = "round(ur_total_hours, 7) as ur_total_hours, " + ", ".join(
    f"round({c}, 4) as {c}" for c in ("rmse", "mae", "ur", "ur_mean_hours", "ur_std_hours"))


@query("count_jobs", "select exit_state, count(*) as n_jobs from jobs group by exit_state")
def _count(spark, sf_dir):
    return M.count_jobs(jobs(spark, sf_dir), ["exit_state"])


@query("distinct_values", "select distinct usr from jobs")
def _distinct(spark, sf_dir):
    return M.distinct_values(jobs(spark, sf_dir), "usr")


@query("min_max", """
select jnam, min(run_time) as min_run_time, max(run_time) as max_run_time, min(adt) as min_adt, max(adt) as max_adt
from jobs group by jnam""")
def _minmax(spark, sf_dir):
    return M.min_max(jobs(spark, sf_dir), ["run_time", "adt"], ["jnam"])


@query("bin_counts", """
, b as (select jnam, run_time as v, min(run_time) over (partition by jnam) as lo,
  max(run_time) over (partition by jnam) as hi from jobs where run_time is not null)
select jnam, case when v = hi then 10 else least(cast(floor((v - lo) * 10 / (hi - lo)) as int), 9) end as bin,
  count(*) as n from b group by all""")
def _bins(spark, sf_dir):
    binned = equal_width_bins(jobs(spark, sf_dir).where(F.col("run_time").isNotNull()), "run_time", ["jnam"])
    return M.bin_counts(binned, "bin", ["jnam"])


@query("mean_impute", """
, w as (select job_id, window_start, mszl, case when not isinf(freq_req) then freq_req end as freq_req
  from jobs join windows3 on edt >= window_start and edt < window_end)
select job_id, window_start, round(coalesce(mszl, avg(mszl) over (partition by window_start)), 6) as mszl,
  round(coalesce(freq_req, avg(freq_req) over (partition by window_start)), 6) as freq_req from w""")
def _impute(spark, sf_dir):
    placed = assign_windows_tumbling(jobs(spark, sf_dir), "edt", 3, SPEC.first_window, SPEC.last_window)
    return rounded(M.mean_impute(placed.select("job_id", "window_start", "mszl", "freq_req"),
                                 ["mszl", "freq_req"], ["window_start"]))


@query("minmax_scale", """
, s as (select job_id, cnumr, elpl, mszl, 5.0::double as constant from jobs)
select job_id, round((cnumr - min(cnumr) over ()) / (max(cnumr) over () - min(cnumr) over ()), 6) as cnumr,
  round((elpl - min(elpl) over ()) / (max(elpl) over () - min(elpl) over ()), 6) as elpl,
  round((mszl - min(mszl) over ()) / (max(mszl) over () - min(mszl) over ()), 6) as mszl,
  0.0::double as constant from s""")
def _scale(spark, sf_dir):
    cols = ["cnumr", "elpl", "mszl", "constant"]
    return rounded(M.minmax_scale(jobs(spark, sf_dir).withColumn("constant", F.lit(5.0)).select("job_id", *cols), cols))


@query("underpred_bias", """
, u as (select window_start, model, case when act > pred then act - pred end as short from window_preds where bias = 'none'),
m as (select window_start, model, median(short) as med from u group by all),
d as (select window_start, model, median(abs(short - med)) as mad from u join m using (window_start, model) group by all)
select window_start, model, round(avg(short), 4) as mean, round(any_value(mad), 4) as mad,
  round(stddev_pop(short), 4) as std_dev, round(2 * stddev_pop(short), 4) as two_sigma, count(short) as n_under
from u join d using (window_start, model) group by all""")
def _bias(spark, sf_dir):
    plain = kept(window_preds(spark, sf_dir).where(F.col("bias") == "none").select(
        "window_start", "model", "act", "pred"))
    return rounded(M.underpred_bias(plain, ["window_start", "model"]), 4)


@query("exact_quantile", """
select jnam, round(quantile_cont(run_time, 0.5), 6) as run_half, round(quantile_cont(run_time, 0.9), 6) as run_most,
  round(quantile_cont(elpl, 0.25), 6) as asked_quarter from jobs group by jnam""")
def _quantile(spark, sf_dir):
    """So few values are left to order that the bounds close in several rounds, also on values that many jobs share."""
    rows = kept(jobs(spark, sf_dir).select("jnam", "run_time", "elpl"))
    half, most = [exact_quantile(rows, "run_time", ["jnam"], p, out, rest=4) for p, out in ((0.5, "run_half"), (0.9, "run_most"))]
    return rounded(half.join(most, "jnam").join(exact_quantile(rows, "elpl", ["jnam"], 0.25, "asked_quarter", rest=4), "jnam"))


@query("underpred_bias_by_rounds", """
, u as (select model, case when act > pred then act - pred end as short from window_preds where bias = 'none'),
m as (select model, median(short) as med from u group by all),
d as (select model, median(abs(short - med)) as mad from u join m using (model) group by all)
select model, round(avg(short), 4) as mean, round(any_value(mad), 4) as mad,
  round(stddev_pop(short), 4) as std_dev, round(2 * stddev_pop(short), 4) as two_sigma, count(short) as n_under
from u join d using (model) group by all""")
def _bias_rounds(spark, sf_dir):
    plain = kept(window_preds(spark, sf_dir).where(F.col("bias") == "none").select("model", "act", "pred"))
    return rounded(M.underpred_bias(plain, ["model"], rest=8), 4)


@query("rmse", "select model, bias, round(sqrt(avg((pred - act) * (pred - act))), 4) as rmse from window_preds group by all")
def _rmse(spark, sf_dir):
    return rounded(M.rmse(window_preds(spark, sf_dir), ["model", "bias"]), 4)


@query("mae", "select model, bias, round(avg(abs(pred - act)), 4) as mae from window_preds group by all")
def _mae(spark, sf_dir):
    return rounded(M.mae(window_preds(spark, sf_dir), ["model", "bias"]), 4)


@query("r2_score", """
select model, bias, round(1 - sum((act - pred) * (act - pred)) / (var_pop(act) * count(*)), 6) as r2
from window_preds group by all""")
def _r2(spark, sf_dir):
    return rounded(M.r2_score(window_preds(spark, sf_dir), ["model", "bias"]))


@query("underpred_ratio", METRICS + f"select {KEYS}, round(ur, 4) as ur from wm")
def _ur(spark, sf_dir):
    return rounded(M.underpred_ratio(window_preds(spark, sf_dir), M.EXPERIMENT_KEYS), 4)


@query("underpred_amounts", METRICS + f"""
select {KEYS}, round(ur_total_hours, 7) as ur_total_hours, round(ur_mean_hours, 4) as ur_mean_hours,
  round(ur_std_hours, 4) as ur_std_hours from wm""")
def _amounts(spark, sf_dir):
    return rounded(M.underpred_amounts(window_preds(spark, sf_dir), M.EXPERIMENT_KEYS), 4)


@query("window_metrics", METRICS + f"select {KEYS}, {ROUND_METRICS} from wm")
def _metrics(spark, sf_dir):
    return rounded(M.window_metrics(window_preds(spark, sf_dir)), 4)


@query("average_metrics", METRICS + """
select window_size, model, bias, round(avg(rmse), 4) as avg_rmse, round(avg(mae), 4) as avg_mae,
  round(avg(ur), 4) as avg_ur, round(avg(ur_total_hours), 7) as avg_ur_total_hours,
  round(avg(ur_mean_hours), 4) as avg_ur_mean_hours, round(avg(ur_std_hours), 4) as avg_ur_std_hours
from wm group by all""")
def _averages(spark, sf_dir):
    return rounded(M.average_metrics(M.window_metrics(window_preds(spark, sf_dir))), 4)


@query("pooled_success_rate", """
select model, bias, count(*) as n_jobs, count(*) filter (ceil(pred) < act) as n_under,
  round(100 - 100.0::double * count(*) filter (ceil(pred) < act) / count(*), 6) as success_rate,
  round(100.0::double * count(*) filter (ceil(pred) < act) / count(*), 6) as under_rate
from window_preds group by all""")
def _pooled(spark, sf_dir):
    return rounded(M.pooled_success_rate(window_preds(spark, sf_dir), ceil=True))


@query("overprediction_totals", """
select model, bias, round(coalesce(sum(req - act) filter (act < req), 0) / 3600, 7) as user_over_hours,
  round(coalesce(sum(pred - act) filter (act < pred), 0) / 3600, 7) as model_over_hours
from window_preds group by all""")
def _totals(spark, sf_dir):
    return rounded(M.overprediction_totals(window_preds(spark, sf_dir), ["model", "bias"]), 4)


@query("wait_by_request_bin", """
, bins as (select * from (values (0, '0-10min', 0, 10), (1, '10min-1hr', 10, 60), (2, '1hr-2hrs', 60, 120),
  (3, '2hrs-4hrs', 120, 240), (4, '4hrs-8hrs', 240, 480), (5, '8hrs-16hrs', 480, 960),
  (6, '16hrs-1day', 960, 1440), (7, '1day-2days', 1440, 2880), (8, '2days-4days', 2880, 5760),
  (9, '4days-8days', 5760, 11520), (10, '8days-16days', 11520, 23040)) b(bin_id, label, lo, hi))
select bin_id, label, round(avg(wait_time / 3600), 6) as mean_wait_hours, count(job_id) as n_jobs
from bins left join jobs on elpl / 60 > lo and elpl / 60 <= hi group by all""")
def _wait(spark, sf_dir):
    units = hours_minutes_units(jobs(spark, sf_dir), {
        "wallclock_req_min": ("elpl", 60), "wait_hours": ("wait_time", 3600)})
    return rounded(M.wait_by_request_bin(units))


RANGED = """, r as (select model, bias, window_start, abs(act - pred) / 60 as x, case when act <= 0 then null
  when act <= 3600 then 0 when act <= 21600 then 1 when act <= 43200 then 2 when act <= 86400 then 3
  when act <= 172800 then 4 end as act_range from window_preds)
"""


@query("error_histogram", RANGED + """, h as (select model, bias, act_range, case when x = 10000 then 49 when x > 0 then
  cast(floor(49 * (log10(x) + 3) / 7) as bigint) + 1 end as error_bin from r where act_range is not null)
select model, bias, act_range, error_bin, count(*) as n_jobs from h
where error_bin between 1 and 49 group by all""")
def _histogram(spark, sf_dir):
    return M.error_histogram(window_preds(spark, sf_dir), ["model", "bias"])


@query("median_error_by_range", RANGED + """, w as (select model, bias, window_start, act_range, median(x) as m
  from r where act_range is not null group by all)
select model, bias, act_range, [0, 3600, 21600, 43200, 86400, 172800][act_range + 1] as range_from,
  [0, 3600, 21600, 43200, 86400, 172800][act_range + 2] as range_to,
  ['(0m, 1h]', '(1h, 6h]', '(6h, 12h]', '(12h, 1d]', '(1d, 2d]'][act_range + 1] as bounds_label,
  round(median(m), 4) as median_error_min, case when median(m) > 60 then format('{:.1f} hours', median(m) / 60)
    else format('{:.1f} minutes', median(m)) end as error_label from w group by all""")
def _median(spark, sf_dir):
    medians = M.median_error_by_range(kept(window_preds(spark, sf_dir)), by=["model", "bias"])
    labelled = format_error_label(format_bounds_label(medians, "range_from", "range_to"), "median_error_min")
    return rounded(labelled, 4)


@query("boxplot_stats", METRICS + """, t as (unpivot (select window_size, model, bias, ur, ur_mean_hours, ur_std_hours
  from wm) on ur, ur_mean_hours, ur_std_hours into name metric value value),
q as (select window_size, model, bias, metric, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
  quantile_cont(value, 0.75) as q3 from t group by all)
select window_size, model, bias, metric, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
  round(min(value) filter (value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1)), 4) as whisker_low,
  round(max(value) filter (value between q1 - 1.5::double * (q3 - q1) and q3 + 1.5::double * (q3 - q1)), 4) as whisker_high,
  count(*) filter (value < q1 - 1.5::double * (q3 - q1) or value > q3 + 1.5::double * (q3 - q1)) as n_outliers
from t join q using (window_size, model, bias, metric) group by window_size, model, bias, metric, q1, median, q3""")
def _box(spark, sf_dir):
    metrics = M.window_metrics(window_preds(spark, sf_dir))
    return rounded(M.boxplot_stats(metrics, ["ur", "ur_mean_hours", "ur_std_hours"]), 4)


@query("kde_density", """
, f as (select model, log10(pred / act) as x from preds union all
  select 'user_request', log10(req / act) from preds where model = 'request_half'),
s as (select model, count(*) as n, stddev_samp(x) * pow(count(*), -0.2::double) as bw, min(x) as lo, max(x) as hi
  from f group by model),
g as (select model, n, bw, i as grid_id, lo - 3 * bw + i * (hi - lo + 6 * bw) / 199 as gx
  from s cross join (select unnest(range(200)) as i))
select g.model, grid_id, round(any_value(gx), 6) as log10_x,
  round(sum(exp(-0.5::double * ((gx - x) / bw) * ((gx - x) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6)
    as density
from g join f on g.model = f.model group by g.model, grid_id""")
def _kde(spark, sf_dir):
    factors = overestimation_factor(preds(spark, sf_dir))
    series = F.array(
        F.struct("model", F.col("overestimation_factor").alias("factor")),
        F.struct(F.when(F.col("model") == "request_half", "user_request").alias("model"),
                 F.col("user_overestimation_factor").alias("factor")))
    tall = kept(factors.select(F.inline(series)).where(F.col("model").isNotNull()))
    return rounded(M.kde_density(tall, "factor", ["model"]))


@query("kmeans_wcss", CENTER_VIEW + """
select cluster, count(*) as n_jobs, round(sum(d), 2) as wcss from placed group by cluster""")
def _wcss(spark, sf_dir):
    return rounded(kmeans_wcss(jobs(spark, sf_dir), ["cnumr", "elpl"], CENTERS), 2)


@query("apply_bias", """
, b as (select model, avg(act - pred) as mean, stddev_pop(act - pred) as std_dev, median(act - pred) as med
  from preds where act > pred group by model),
m as (select preds.model, median(abs(act - pred - med)) as mad from preds join b on preds.model = b.model
  where act > pred group by preds.model)
select job_id, p.model, act, req, t.bias, round(pred + case t.bias when 'none' then 0 when 'mean' then b.mean
  when 'mad' then m.mad when 'std_dev' then b.std_dev else 2 * b.std_dev end, 4) as pred
from preds p join b on b.model = p.model join m on m.model = p.model
  cross join (values ('none'), ('mean'), ('mad'), ('std_dev'), ('two_sigma')) t(bias)""")
def _apply(spark, sf_dir):
    plain = kept(preds(spark, sf_dir).select("job_id", "model", "act", "req", "pred"))
    biases = M.underpred_bias(plain, ["model"])
    return rounded(M.apply_bias(plain, biases, M.BIAS_TYPES, ["model"]), 4)


@query("group_mean_predictor", """
, w as (select job_id, jnam, window_start, run_time,
    ('0x' || substr(md5(job_id::varchar || ':33'), 1, 8))::bigint % 10000 < 2000 as is_test
  from finished join windows3 on edt >= window_start and edt < window_end),
m as (select window_start, jnam, avg(run_time) as pred from w where not is_test group by all)
select job_id, window_start, jnam, round(pred, 6) as pred, run_time as act
from w join m using (window_start, jnam) where is_test""")
def _mean(spark, sf_dir):
    from jobcast.checks.plans import split_windows

    rows = split_windows(spark, sf_dir)
    out = M.group_mean_predictor(rows.where(~F.col("is_test")), rows.where("is_test"), "run_time",
                                 ["window_start", "jnam"])
    return rounded(out.select("job_id", "window_start", "jnam", "pred", "act"))
