"""Training and scoring.

The queries under the operators' own names fit single trees, whose leaf means SQL
can recompute: the whole path through Spark ML, buffers and scoring is compared.
``*_ensembles`` run the same path with boosted trees and forests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.checks.registry import SPEC, finished, kept, query, rounded
from jobcast.checks.sampling import hash32
from jobcast.operators.metrics import BIAS_TYPES, r2_score, rmse
from jobcast.operators.sampling import split_hash
from jobcast.operators.windows import assign_windows_tumbling
from jobcast.plans import train as T
from jobcast.plans.experiment import fit_centers
from jobcast.plans.models import StoredModels
from jobcast.session import fresh_path

# Half-month windows cover the whole trace.
HALF_MONTHS = SPEC.with_(first_window="2024-01-01", last_window="2024-01-17", window_days=16,
                         window_step="16D", clusters=2)
LEAVES = HALF_MONTHS.with_(features=("nnumr", "freq_req"))
FEATURES = ("nnumr", "queue")

SPLIT = f"{hash32(33)} % 10000 < 2000 as is_test, {hash32(42)} % 10000 < 4000 as is_val"
ROWS = f"""
, rows as (select job_id, run_time as y, elpl as req, nnumr, cast(k % 2 as int) as cluster,
    case when edt < timestamp '2024-01-17' then timestamp '2024-01-01' else timestamp '2024-01-17' end as window_start,
    {SPLIT} from finished)
"""


def buffers_sql(scored: str, by: str) -> str:
    """Buffers from a relation ``(by..., model, y, pred)`` as CTE ``buffers``."""
    match = " and ".join(f"{{0}}.{c} = {{1}}.{c}" for c in by.split(", "))
    return f"""
, short as (select {by}, case when y > pred then y - pred end as s from {scored}),
mid as (select {by}, median(s) as med from short group by {by}),
buffers as (select short.{by.replace(", ", ", short.")}, avg(s) as mean, median(abs(s - med)) as mad,
  stddev_pop(s) as std_dev, 2 * stddev_pop(s) as two_sigma, count(s) as n_under
  from short join mid on {match.format("short", "mid")} group by short.{by.replace(", ", ", short.")})
"""


SHOW_BUFFERS = """round(mean, 4) as mean, round(mad, 4) as mad, round(std_dev, 4) as std_dev,
  round(two_sigma, 4) as two_sigma, n_under from buffers"""
BUFFER_OF = """case t.bias when 'none' then 0 when 'mean' then b.mean when 'mad' then b.mad
  when 'std_dev' then b.std_dev else b.two_sigma end"""
BIAS_LIST = "(values ('none'), ('mean'), ('mad'), ('std_dev'), ('two_sigma')) t(bias)"


def trace(spark, sf_dir) -> DataFrame:
    return finished(spark, sf_dir).select("job_id", "edt", "run_time", *SPEC.features)


def labelled(spark, sf_dir) -> DataFrame:
    """Finished jobs of half-month windows, grouped by a given two-valued queue."""
    placed = assign_windows_tumbling(finished(spark, sf_dir), "edt", 16, "2024-01-01", "2024-01-17")
    return placed.select("job_id", "window_start", (F.col("k") % 2).cast("int").alias("cluster"), "run_time", "elpl",
                         "nnumr", ((F.col("k") % 2) * 1000).cast("double").alias("queue"))


LOG_LEAF = "exp(avg(ln(y)))"


@query("train_global_gbt", ROWS + f"""
, leaf as (select cluster, nnumr, {LOG_LEAF} as pred from rows where not is_val group by all),
scored as (select 'baseline' as model, y, pred from rows join leaf
  on leaf.cluster = rows.cluster and leaf.nnumr = rows.nnumr where is_val)
""" + buffers_sql("scored", "model") + "select model, " + SHOW_BUFFERS)
def _global(spark, sf_dir):
    return rounded(T.train_global_gbt(labelled(spark, sf_dir), FEATURES, "run_time", "one_tree").biases, 4)


@query("predict_global", ROWS + f"""
, leaf as (select cluster, nnumr, {LOG_LEAF} as pred from rows where not is_test and not is_val group by all),
scored as (select 'baseline' as model, y, req, is_test, pred from rows join leaf
  on leaf.cluster = rows.cluster and leaf.nnumr = rows.nnumr where is_test or is_val)
""" + buffers_sql("(select * from scored where not is_test)", "model") + f"""
, final as (select t.bias, y, pred + {BUFFER_OF} as pred from scored cross join buffers b cross join {BIAS_LIST}
  where is_test)
select bias, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) as r2,
  round(sqrt(avg((y - pred) * (y - pred))), 6) as rmse, count(*) as n_jobs from final group by bias""")
def _predict_global(spark, sf_dir):
    rows = split_hash(labelled(spark, sf_dir), "job_id", 0.2, 33)
    trained = T.train_global_gbt(rows.where(~F.col("is_test")), FEATURES, "run_time", "one_tree")
    preds = T.predict_global(rows.where("is_test"), trained, BIAS_TYPES, "elpl")
    counts = preds.groupBy("bias").agg(F.count("*").alias("n_jobs"))
    return rounded(r2_score(preds, ["bias"]).join(rmse(preds, ["bias"]), "bias").join(counts, "bias"))


def cluster_sql(model: str, leaf: str) -> str:
    return ROWS + f"""
, leaf as (select window_start, cluster, nnumr, {leaf} as pred from rows where not is_val group by all),
scored as (select rows.window_start, rows.cluster, '{model}' as model, y, pred from rows join leaf
  on leaf.window_start = rows.window_start and leaf.cluster = rows.cluster and leaf.nnumr = rows.nnumr where is_val)
""" + buffers_sql("scored", "window_start, cluster, model") + "select window_start, cluster, model, " + SHOW_BUFFERS


@query("train_cluster_gbt", cluster_sql("clustering_xgb", LOG_LEAF))
def _gbt(spark, sf_dir):
    return rounded(T.train_cluster_gbt(labelled(spark, sf_dir), FEATURES, "run_time", "reference").biases, 4)


@query("train_cluster_rf", cluster_sql("clustering_rf", "avg(y)"))
def _rf(spark, sf_dir):
    return rounded(T.train_cluster_rf(labelled(spark, sf_dir), FEATURES, "run_time", "one_tree").biases, 4)


@query("train_resampled", ROWS + f"""
, lim as (select *, min(y) over (partition by window_start, cluster) as lo,
  max(y) over (partition by window_start, cluster) as hi from rows where not is_val),
binned as (select *, case when y = hi then 10 else least(cast(floor((y - lo) * 10 / (hi - lo)) as int), 9) end as bin
  from lim),
numbered as (select *, row_number() over (partition by window_start, cluster, bin order by {hash32(42)}, job_id) as r
  from binned),
sizes as (select window_start, cluster, bin, count(*) as n,
  max(count(*)) over (partition by window_start, cluster) as most
  from binned group by window_start, cluster, bin),
draws as (select *, unnest(generate_series(1, most)) as draw from sizes),
picks as (select *, ('0x' || substr(md5(concat_ws(':', window_start, cluster, bin, draw, '42')), 1, 12))::bigint
  % n + 1 as pick from draws),
sample as (select n.* from picks p join numbered n on n.window_start = p.window_start and n.cluster = p.cluster
  and n.bin = p.bin and n.r = p.pick),
leaf as (select 'resampled_rf' as model, window_start, cluster, nnumr, avg(y) as pred from sample group by all
  union all select 'resampled_xgb', window_start, cluster, nnumr, {LOG_LEAF} from sample group by all),
scored as (select rows.window_start, rows.cluster, model, y, pred from rows join leaf
  on leaf.window_start = rows.window_start and leaf.cluster = rows.cluster and leaf.nnumr = rows.nnumr where is_val)
""" + buffers_sql("scored", "window_start, cluster, model") + "select window_start, cluster, model, " + SHOW_BUFFERS)
def _resampled(spark, sf_dir):
    return rounded(T.train_variants(labelled(spark, sf_dir), FEATURES, "run_time",
                                    ["resampled_xgb", "resampled_rf"], "one_tree").biases, 4)


PREDICTED = ROWS + f"""
, leaf as (select 'clustering_rf' as model, window_start, cluster, nnumr, avg(y) as pred
    from rows where not is_test and not is_val group by all
  union all select 'clustering_xgb', window_start, cluster, nnumr, {LOG_LEAF}
    from rows where not is_test and not is_val group by all),
scored as (select job_id, rows.window_start, rows.cluster, model, is_test, y, req, pred from rows join leaf
  on leaf.window_start = rows.window_start and leaf.cluster = rows.cluster and leaf.nnumr = rows.nnumr
  where is_test or is_val)
""" + buffers_sql("(select * from scored where not is_test)", "window_start, cluster, model")


@query("predict_per_cluster", PREDICTED + f"""
select job_id, s.window_start, s.cluster, s.model, t.bias, y as act, req, round(pred + {BUFFER_OF}, 4) as pred
from scored s join buffers b on b.window_start = s.window_start and b.cluster = s.cluster and b.model = s.model
  cross join {BIAS_LIST} where is_test""")
def _predict(spark, sf_dir):
    """Jobs without a cluster: placed by the store's centres, scored by the store's models."""
    rows = kept(split_hash(labelled(spark, sf_dir), "job_id", 0.2, 33).drop("cluster"))
    train, root = rows.where(~F.col("is_test")), fresh_path(spark, "model-store")
    # k-means numbers its groups as it likes; the SQL calls the long queue 1
    centers = fit_centers(train, FEATURES, 2).withColumn("cluster", (F.col("center")[1] > 500).cast("int"))
    T.train_variants(train, FEATURES, "run_time", ["clustering_rf", "clustering_xgb"], "one_tree", centers=centers, root=root)
    return rounded(T.predict_per_cluster(rows.where("is_test"), StoredModels(spark, root), BIAS_TYPES, "elpl"), 4)
