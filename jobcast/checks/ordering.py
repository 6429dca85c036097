from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import FIRST, LAST, jobs, kept, query
from jobcast.operators import encode as E
from jobcast.operators.dictionary import encode_with, grow_dictionary
from jobcast.operators.windows import assign_windows_tumbling
from jobcast.session import fresh_path

CURVES = """, c as (select window_start, k.k as k, job_id % k.k as label, elpl from jobs
  join windows3 on edt >= window_start and edt < window_end cross join (select unnest(range(2, 9)) as k) k),
g as (select window_start, k, label, var_pop(elpl) * count(*) as ss, count(*) as n from c group by all),
curves as (select window_start, cast(k as int) as k, round(sum(ss) / 1e6, 3) as wcss,
  round(sum(ss) / sum(n) / 1e9 * ((k * 5) % 7), 6) as silhouette from g group by window_start, k)
"""


def curves(spark, sf_dir):
    """A tuning curve per window whose groups are fixed: remainders of the job number."""
    placed = assign_windows_tumbling(jobs(spark, sf_dir), "edt", 3, FIRST, LAST)
    labelled = placed.select("window_start", "job_id", "elpl", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("k"))
    sums = labelled.groupBy("window_start", "k", (F.col("job_id") % F.col("k")).alias("label")).agg(
        (F.var_pop("elpl") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    return sums.groupBy("window_start", "k").agg(
        F.round(F.sum("ss") / 1e6, 3).alias("wcss"),
        F.round(F.sum("ss") / F.sum("n") / 1e9 * ((F.col("k") * 5) % 7), 6).alias("silhouette"))


CODED = """
, coded as (select job_id, dense_rank() over (order by usr) - 1 as usr,
  case when run_time is null then (select count(distinct run_time) from jobs)
    else dense_rank() over (order by run_time nulls last) - 1 end as run_time,
  dense_rank() over (order by jnam) - 1 as jnam,
  dense_rank() over (order by jid) - 1 as jid,
  dense_rank() over (order by case when mszl is null then 'nan' else mszl::varchar end) - 1 as mszl_text from jobs)
select * from coded"""


@query("label_encode_by_shuffle", CODED)
def _encode_by_shuffle(spark, sf_dir):
    """No dictionary fits a broadcast: frequent values first, the others by a spread join."""
    return _encode(spark, sf_dir, max_rows=0)


@query("label_encode", CODED)
def _encode(spark, sf_dir, **options):
    rows = kept(jobs(spark, sf_dir).select(
        "job_id", "usr", "run_time", "jnam", "jid", F.col("mszl").alias("mszl_text")))
    native = E.label_encode(rows, ["usr", "run_time", "jnam", "jid"], **options)
    return E.label_encode(native, ["mszl_text"], as_string=True, **options)


FIRST_SEEN = """
, f as (select usr, row_number() over (order by min(row(adt, job_id))) as usr_id from jobs group by usr)
select job_id, jobs.usr, usr_id from jobs join f on jobs.usr = f.usr"""


@query("first_seen_id_by_shuffle", FIRST_SEEN)
def _first_by_shuffle(spark, sf_dir):
    return _first(spark, sf_dir, max_rows=0)


@query("first_seen_id", FIRST_SEEN)
def _first(spark, sf_dir, **options):
    return E.first_seen_id(jobs(spark, sf_dir).select("job_id", "adt", "usr"), "usr", ["adt", "job_id"], **options).drop("adt")


@query("sequential_job_number", """
select job_id, row_number() over (order by sdt, job_id) as job_number from jobs""")
def _number(spark, sf_dir):
    return E.sequential_job_number(jobs(spark, sf_dir).select("job_id", "sdt"), ["sdt", "job_id"]).drop("sdt")


@query("sort_trace", """
select job_id, edt, run_time from jobs order by edt nulls last, job_id""")
def _sort(spark, sf_dir):
    return E.sort_trace(jobs(spark, sf_dir).select("job_id", "edt", "run_time"), ["edt", "job_id"])


@query("wcss_second_diff", CURVES + """
select *, round(lead(first_diff) over (partition by window_start order by k) - first_diff, 3) as second_diff
from (select *, round(lead(wcss) over (partition by window_start order by k) - wcss, 3) as first_diff from curves)""")
def _diff(spark, sf_dir):
    return E.wcss_second_diff(curves(spark, sf_dir)).withColumns({
        "first_diff": F.round("first_diff", 3), "second_diff": F.round("second_diff", 3)})


@query("elbow_k", CURVES + """
, d1 as (select *, lead(wcss) over (partition by window_start order by k) - wcss as d,
  row_number() over (partition by window_start order by k) - 1 as i from curves),
d2 as (select *, lead(d) over (partition by window_start order by k) - d as dd from d1)
select window_start, cast(coalesce(min(i) filter (dd < 0), 0) + 2 as int) as elbow_k from d2 group by window_start""")
def _elbow(spark, sf_dir):
    return E.elbow_k(curves(spark, sf_dir))


@query("silhouette_k", CURVES + """
select window_start, k as silhouette_k from (select *, row_number() over
  (partition by window_start order by silhouette desc, k) as r from curves) where r = 1""")
def _silhouette(spark, sf_dir):
    return E.silhouette_k(curves(spark, sf_dir))


@query("random_sample_n", """
select job_id, elpl, run_time from jobs
order by ('0x' || substr(md5(job_id::varchar || ':7'), 1, 8))::bigint, job_id limit 100""")
def _sample(spark, sf_dir):
    return E.random_sample_n(jobs(spark, sf_dir).select("job_id", "elpl", "run_time"), "job_id", 100, 7)


@query("label_encode_growing", """
, early as (select * from jobs where adt < timestamp '2024-01-03'), late as (select * from jobs where adt >= timestamp '2024-01-03'),
u1 as (select usr, row_number() over (order by usr) - 1 as code from (select distinct usr from early)),
u2 as (select usr, (select count(*) from u1) + row_number() over (order by usr) - 1 as code
  from (select distinct usr from late where usr not in (select usr from u1))),
us as (select * from u1 union all select * from u2),
m1 as (select mszl, row_number() over (order by mszl nulls last) - 1 as code from (select distinct mszl from early)),
m2 as (select mszl, (select count(*) from m1) + row_number() over (order by mszl nulls last) - 1 as code
  from (select distinct mszl from late) l where not exists (select 1 from m1 where m1.mszl is not distinct from l.mszl)),
ms as (select * from m1 union all select * from m2)
select job_id, us.code as usr, ms.code as mszl from jobs join us on us.usr = jobs.usr join ms on ms.mszl is not distinct from jobs.mszl""")
def _growing(spark, sf_dir):
    """Two batches through one dictionary: the later one's new users come behind, no code changes."""
    rows, root = kept(jobs(spark, sf_dir).select("job_id", "adt", "usr", "mszl")), fresh_path(spark, "dictionary")
    start = F.lit("2024-01-03").cast("timestamp_ntz")
    grow_dictionary(rows.where(F.col("adt") < start), ["usr", "mszl"], root)
    grow_dictionary(rows.where(F.col("adt") >= start), ["usr", "mszl"], root)
    return encode_with(rows.drop("adt"), ["usr", "mszl"], root)
