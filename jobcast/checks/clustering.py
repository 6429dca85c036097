from __future__ import annotations

from pyspark.sql import functions as F

from jobcast.checks.registry import SPEC, finished, jobs, kept, query, rounded
from jobcast.operators import cluster as C
from jobcast.operators.metrics import mean_impute, minmax_scale


@query("kmeans_group_jobs", """
, p as (select job_id, cast(k % 2 as int) as side, coalesce(mszl, avg(mszl) over ()) / 16384 as m, nnumr from finished)
select job_id, side as cluster_rank, count(*) over (partition by side) as n_jobs,
  round(avg(nnumr) over (partition by side), 6) as center_nodes,
  round(avg(m) over (partition by side), 6) as center_memory from p""")
def _group(spark, sf_dir):
    """Two queues far apart, so that the best grouping is known; ids are ranked by centre."""
    rows = kept(finished(spark, sf_dir).select(
        "job_id", "nnumr", ((F.col("k") % 2) * 1000).cast("double").alias("queue"),
        (F.col("mszl") / 16384).alias("memory")))
    placed, model = C.kmeans_group_jobs(rows, ["queue", "nnumr", "memory"], 2)
    ranked = sorted(range(2), key=lambda i: model.clusterCenters()[i][0])
    centers = spark.createDataFrame(
        [(int(c), rank, int(model.summary.clusterSizes[c]), *[float(x) for x in model.clusterCenters()[c][1:]])
         for rank, c in enumerate(ranked)],
        "cluster int, cluster_rank int, n_jobs long, center_nodes double, center_memory double")
    return rounded(placed.join(F.broadcast(centers), "cluster").select(
        "job_id", "cluster_rank", "n_jobs", "center_nodes", "center_memory"))


SIDES = """
, p0 as (select k % 2 as q, (run_time - min(run_time) over ()) / (max(run_time) over () - min(run_time) over ()) as r
  from finished),
p as (select q, r, q * q + r * r as sq from p0),
s as (select q, count(*) as n, avg(q) as mq, avg(r) as mr, avg(sq) as ms from p group by q)
"""


def sides(spark, sf_dir):
    """Two queues far apart, for which the best two groups are known."""
    return kept(finished(spark, sf_dir).select(((F.col("k") % 2) * 1000).alias("queue"), "run_time"))


@query("wcss_curve_sides", SIDES + """
select 2 as k, round(sum(power(p.q - mq, 2) + power(r - mr, 2)), 6) as wcss from p join s on s.q = p.q""")
def _wcss_sides(spark, sf_dir):
    return rounded(C.wcss_curve(sides(spark, sf_dir), ["queue", "run_time"], 2))


@query("silhouette_curve_sides", SIDES + """
, d as (select (o.ms - 2 * (p.q * o.mq + r * o.mr) + sq) * o.n / (o.n - 1) as a,
    t.ms - 2 * (p.q * t.mq + r * t.mr) + sq as b from p join s o on o.q = p.q join s t on t.q <> p.q)
select 2 as k, round(avg((b - a) / greatest(a, b)), 6) as silhouette from d""")
def _silhouette_sides(spark, sf_dir):
    return rounded(C.silhouette_curve(sides(spark, sf_dir), ["queue", "run_time"], 2))


def places(spark, sf_dir):
    """Ten equally distant places of as many jobs: whatever places a group joins, its measures are known."""
    names = [f"q{i}" for i in range(10)]
    return jobs(spark, sf_dir).select(*[(F.col("job_id") % 10 == i).cast("double").alias(q) for i, q in enumerate(names)]), names


COSTS = """, curve as (select cast(k as int) as k, n * (10 - k) / 10.0 as wcss, k / 10.0 as silhouette
  from (select count(*) as n from jobs) cross join (select unnest(generate_series(2, 10)) as k))"""


@query("wcss_curve_places", COSTS + " select k, round(wcss, 6) as wcss from curve")
@query("wcss_curve", COSTS + " select k, round(wcss, 6) as wcss from curve")
def _wcss(spark, sf_dir):
    return rounded(C.wcss_curve(*places(spark, sf_dir)))


@query("silhouette_curve_places", COSTS + " select k, round(silhouette, 2) as silhouette from curve")
def _silhouette_places(spark, sf_dir):
    return rounded(C.silhouette_curve(*places(spark, sf_dir)), 2)


# Distance of each queue from the origin, in times the range of the run times.
APART = 30


def queues(spark, sf_dir):
    """Every job in each of ten queues far apart, placed there by its run time.

    The squared distance from a job to another queue's centre is the sum of the two squares, so all queues without a centre
    join the same one: k groups are k - 1 single queues and the 11 - k others. As the queues are alike, any choice measures the same.
    """
    times = mean_impute(kept(jobs(spark, sf_dir).select("run_time")), ["run_time"])
    placed = minmax_scale(times, ["run_time"]).withColumn("queue", F.explode(F.sequence(F.lit(0), F.lit(9))))
    names = [f"q{i}" for i in range(10)]
    return placed.select(*[F.when(F.col("queue") == i, APART + F.col("run_time")).otherwise(0.0).alias(q) for i, q in enumerate(names)]), names


@query("silhouette_curve", f"""
, t as (select coalesce(run_time, avg(run_time) over ()) as t from jobs),
p as (select ({APART} + (t - min(t) over ()) / (max(t) over () - min(t) over ())) / {APART + 1} as x from t),
m as (select count(*) as n, avg(x) as mx, avg(x * x) as ms from p),
d as (select n, x * x - 2 * x * mx + ms as near, x * x + ms as far from p cross join m),
g as (select k, unnest([11 - k, 1]) as size, unnest([1, k - 1]) as times from (select unnest(generate_series(2, 10)) as k)),
s as (select k, size, times, avg((far - a) / greatest(a, far)) as silhouette
  from (select k, size, times, far, n * (near + (size - 1) * far) / (size * n - 1) as a from d cross join g) group by all)
select cast(k as int) as k, round(sum(size * times * silhouette) / 10, 9) as silhouette from s group by k""")
def _silhouette(spark, sf_dir):
    """The whole curve from the jobs' run times, to nine digits, as the distances inside a queue are small."""
    return rounded(C.silhouette_curve(*queues(spark, sf_dir)), 9)


@query("silhouette_exact", """
, p0 as (select wait_time / 30 as x, elpl / 3600 as y,
    case when k < 50 then 0 when elpl < 43200 then 1 else 2 end as label from jobs),
p as (select row_number() over () as id, * from (select x, y, label, count(*) as w from p0 group by all)),
s as (select label, sum(w) as size from p group by label),
t as (select a.id, a.w, a.label, b.label as c, sum(b.w * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as tot
  from p a cross join p b group by all),
ab as (select id, w, max(case when c = t.label then tot / nullif(size - 1, 0) end) as a,
  max(case when c = t.label then size end) as own, min(case when c <> t.label then tot / size end) as b
  from t join s on s.label = t.c group by id, w)
select cast(sum(w) as bigint) as n_jobs,
  round(sum(w * case when own = 1 then 0 else (b - a) / greatest(a, b) end) / sum(w), 6) as silhouette from ab""")
def _exact(spark, sf_dir):
    label = F.when(F.col("k") < 50, 0).when(F.col("elpl") < 43200, 1).otherwise(2)
    points = jobs(spark, sf_dir).select((F.col("wait_time") / 30).alias("x"), (F.col("elpl") / 3600).alias("y"),
                                        label.alias("label"))
    return rounded(C.silhouette_exact(points, ["x", "y"], "label"))


@query("silhouette_exact_continuous", """
, p as (select job_id as id, run_time / 3600 as x, elpl / 3600 as y, cast(k % 3 as int) as label from finished),
s as (select label, count(*) as size from p group by label),
t as (select a.id, a.label, b.label as c, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as tot from p a cross join p b group by all),
ab as (select id, max(case when c = t.label then tot / (size - 1) end) as a, min(case when c <> t.label then tot / size end) as b
  from t join s on s.label = t.c group by id)
select count(*) as n_jobs, round(avg((b - a) / greatest(a, b)), 6) as silhouette from ab""")
def _exact_continuous(spark, sf_dir):
    """Run times that hardly two jobs share, so that the points fill several tiles."""
    points = finished(spark, sf_dir).select((F.col("run_time") / 3600).alias("x"), (F.col("elpl") / 3600).alias("y"), (F.col("k") % 3).alias("label"))
    return rounded(C.silhouette_exact(points, ["x", "y"], "label", tile_points=1000))


@query("optimal_k", COSTS + """
, bends as (select k, lead(wcss, 2) over (order by k) - 2 * lead(wcss) over (order by k) + wcss as bend, max(wcss) over () as most from curve)
select cast(coalesce(min(k) filter (bend < -1e-9 * most), 2) as int) as elbow_k,
  (select cast(max_by(k, silhouette) as int) from curve) as silhouette_k from bends""")
def _optimal(spark, sf_dir):
    """A straight line of costs has no elbow; silhouettes grow up to the number of places."""
    return C.optimal_k(*places(spark, sf_dir))


@query("optimal_k_trace")
def _optimal_trace(spark, sf_dir):
    return C.optimal_k(kept(finished(spark, sf_dir).select(*SPEC.features)), SPEC.features)
