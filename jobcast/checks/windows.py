from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import FIRST, LAST, jobs, query, rounded, table
from jobcast.operators import windows as W
from jobcast.session import store

CENTERS = [[4.0, 7200.0], [12.0, 30000.0], [24.0, 50000.0], [40.0, 80000.0]]
CENTER_VIEW = """, centers as (select * from
  (values (0, 4.0, 7200.0), (1, 12.0, 30000.0), (2, 24.0, 50000.0), (3, 40.0, 80000.0)) c(cluster, x, y)),
placed as (select job_id, cluster, d from (select job_id, cluster,
    (cnumr - x::double) * (cnumr - x::double) + (elpl - y::double) * (elpl - y::double) as d,
    row_number() over (partition by job_id order by
      (cnumr - x::double) * (cnumr - x::double) + (elpl - y::double) * (elpl - y::double), cluster) as r
  from jobs cross join centers) where r = 1)
"""


@query("window_table", """
, starts as (select unnest(generate_series(date_trunc('month', (select min(o_orderdate) from orders)),
    (select max(o_orderdate) from orders)::timestamp, interval 1 month)) as m),
w as (select last_day(m)::timestamp as window_start, last_day(m)::timestamp + interval 90 day as window_end
  from starts where last_day(m) between (select min(o_orderdate)::date from orders)
    and (select max(o_orderdate)::date from orders))
select window_start, window_end, count(o_orderkey) as n_orders from w
  left join orders on o_orderdate >= window_start and o_orderdate < window_end group by all""")
def _table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    span = orders.agg(F.min(F.col("o_orderdate").cast("date")).alias("a"),
                      F.max(F.col("o_orderdate").cast("date")).alias("z")).collect()[0]
    windows = W.window_table(spark, str(span["a"]), str(span["z"]), 90, "1M")
    counts = W.assign_windows_sliding(orders, windows, "o_orderdate").groupBy("window_start").agg(
        F.count("*").alias("n"))
    return windows.join(counts, "window_start", "left").select(
        "window_start", "window_end", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("assign_windows_tumbling", """
select job_id, window_start, window_end from jobs join windows3 on edt >= window_start and edt < window_end""")
def _tumbling(spark, sf_dir):
    return W.assign_windows_tumbling(jobs(spark, sf_dir), "edt", 3, FIRST, LAST).select(
        "job_id", "window_start", "window_end")


@query("assign_windows_sliding", """
select job_id, window_start, window_end from jobs join windows9 on edt >= window_start and edt < window_end""")
def _sliding(spark, sf_dir):
    windows = W.window_table(spark, FIRST, LAST, 9, "3D")
    return W.assign_windows_sliding(jobs(spark, sf_dir).select("job_id", "edt"), windows, "edt").drop("edt")


@query("nearest_center", CENTER_VIEW + "select job_id, cluster from placed")
def _nearest(spark, sf_dir):
    return W.nearest_center(jobs(spark, sf_dir), ["cnumr", "elpl"], CENTERS).select("job_id", "cluster")


@query("lookup_join", """
, dim as (select usr, count(*) as user_jobs, avg(wait_time) as user_wait from jobs
  where exit_state = 'failed' group by usr)
select job_id, jobs.usr, coalesce(user_jobs, -1) as user_jobs, round(coalesce(user_wait, -1), 6) as user_wait
from jobs left join dim on jobs.usr = dim.usr""")
def _lookup(spark, sf_dir):
    trace = jobs(spark, sf_dir)
    dim = trace.where(F.col("exit_state") == "failed").groupBy("usr").agg(
        F.count("*").alias("user_jobs"), F.avg("wait_time").alias("user_wait"))
    return rounded(W.lookup_join(trace.select("job_id", "usr"), store(dim, "users"), "usr"))
