"""The register of queries and the job views that stand in for a trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.operators.windows import assign_windows_tumbling
from jobcast.session import store
from jobcast.spec import FUGAKU

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIRST, LAST = "2024-01-01", "2024-01-28"
SPEC = FUGAKU.with_(key="job_id", state="exit_state", first_window=FIRST, last_window=LAST,
                    target="run_time", features=("cnumr", "nnumr", "elpl", "mszl", "freq_req"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL giving the same rows."""
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = VIEWS + sql
        return f
    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as in the SQL.

    Totals in hours are multiples of 1/72,000 (or a tenth of that): with seven digits none lies half-way.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, 7 if c.endswith(("total_hours", "over_hours")) else digits)
                           for c in doubles}) if doubles else df


def kept(df: DataFrame) -> DataFrame:
    """The input of an operator that reads it several times, derived once."""
    return store(df, "input")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_of(events: DataFrame) -> DataFrame:
    """Each event read as a batch job."""
    e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    k, i = F.col("k"), F.col("event_id")
    zero = F.lit(0.0)
    j = e.select(
        i.alias("job_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"),
        F.col("event_type").alias("jnam"), F.col("ts").alias("adt"), "k", "user_id",
        F.when(F.col("event_type") == "error", "failed").when(k >= 95, "cancelled")
        .otherwise("completed").alias("exit_state"),
        (k * 30).cast("double").alias("wait_time"),
        F.when(i % 500 == 7, F.lit(None)).when(k == 0, zero)
        .otherwise(F.floor(F.col("value") * 300).cast("double")).alias("run_time"),
        (1 + k % 48).cast("double").alias("cnumr"), (1 + k % 5).cast("double").alias("nnumr"),
        (3600 * (1 + i % 24)).cast("double").alias("elpl"),
        F.when(i % 97 != 0, (1024 * (1 + F.col("user_id") % 16)).cast("double")).alias("mszl"),
        F.when(i % 101 == 0, F.lit(float("inf"))).otherwise((2000 + 200 * (k % 2)).cast("double"))
        .alias("freq_req"),
        F.when(k % 10 == 0, zero).otherwise((1 + k % 48).cast("double")).alias("cnumat"),
    )
    hours = F.floor(F.col("elpl") / 3600).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    limit = (F.when(F.col("job_id") % 3 == 0, F.concat(hours.cast("string"), F.lit(":00")))
             .when(F.col("job_id") % 3 == 1, F.concat(two(hours), F.lit(":00:00")))
             .otherwise(F.concat(F.lit("1-"), two(hours % 24), F.lit(":30:15"))))
    return j.withColumns({
        "sdt": F.timestamp_add("SECOND", F.col("wait_time").cast("int"), F.col("adt")),
        "edt": F.timestamp_add("SECOND", (F.col("wait_time") + F.col("run_time")).cast("int"), F.col("adt")),
        "usctmut": F.col("run_time") * F.col("cnumat") * 0.8,
        "mmszu": F.col("mszl") * 0.5,
        "jobenv_req": F.concat(F.lit("env"), (F.col("k") % 3).cast("string")),
        "jid": F.col("job_id").cast("string"),
        "partition": (F.col("k") % 4).cast("string"),
        "qos": (F.col("k") % 3).cast("string"),
        "time_limit_str": limit,
    })


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of(table(spark, sf_dir, "events"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where((F.col("exit_state") == "completed") & (F.col("run_time") > 0))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors that need no training: half the request, and a share of the actual time."""
    share = F.col("run_time") * (F.lit(0.7) + (F.col("job_id") % 13) / F.lit(20.0))
    return finished(spark, sf_dir).select(
        "job_id", "jnam", "edt", F.col("run_time").alias("act"), F.col("elpl").alias("req"),
        F.inline(F.array(
            F.struct(F.lit("request_half").alias("model"), (F.col("elpl") * 0.5).alias("pred")),
            F.struct(F.lit("scaled_actual").alias("model"), share.alias("pred")))))


def window_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``preds`` in tumbling windows, plain and with a fixed buffer of half an hour."""
    placed = assign_windows_tumbling(preds(spark, sf_dir), "edt", 3, FIRST, LAST)
    buffers = F.array(F.struct(F.lit("none").alias("bias"), F.lit(0.0).alias("buffer")),
                      F.struct(F.lit("two_sigma").alias("bias"), F.lit(1800.0).alias("buffer")))
    return placed.select(
        "job_id", "jnam", "act", "req", "model", "pred", F.lit(3).alias("window_size"), "window_start",
        F.inline(buffers)).withColumn("pred", F.col("pred") + F.col("buffer")).drop("buffer")


VIEWS = """
with e as (select event_id, ts, user_id, event_type, value,
  cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events),
j0 as (select event_id as job_id, concat('u', cast(user_id as varchar)) as usr, event_type as jnam,
  ts as adt, k, user_id,
  case when event_type = 'error' then 'failed' when k >= 95 then 'cancelled'
       else 'completed' end as exit_state,
  cast(k * 30 as double) as wait_time,
  case when event_id % 500 = 7 then null when k = 0 then cast(0 as double)
       else cast(floor(value * 300) as double) end as run_time,
  cast(1 + k % 48 as double) as cnumr, cast(1 + k % 5 as double) as nnumr,
  cast(3600 * (1 + event_id % 24) as double) as elpl,
  case when event_id % 97 = 0 then null else cast(1024 * (1 + user_id % 16) as double) end as mszl,
  case when event_id % 101 = 0 then cast('Infinity' as double)
       else cast(2000 + 200 * (k % 2) as double) end as freq_req,
  case when k % 10 = 0 then cast(0 as double) else cast(1 + k % 48 as double) end as cnumat
  from e),
j1 as (select *, cast(elpl / 3600 as int) as h from j0),
jobs as (select * exclude (h), adt + to_seconds(cast(wait_time as int)) as sdt,
  adt + to_seconds(cast(wait_time + run_time as int)) as edt,
  run_time * cnumat * 0.8::double as usctmut, mszl * 0.5::double as mmszu,
  'env' || cast(k % 3 as varchar) as jobenv_req, cast(job_id as varchar) as jid,
  cast(k % 4 as varchar) as partition, cast(k % 3 as varchar) as qos,
  case job_id % 3 when 0 then h || ':00' when 1 then lpad(h::varchar, 2, '0') || ':00:00'
       else '1-' || lpad((h % 24)::varchar, 2, '0') || ':30:15' end as time_limit_str
  from j1),
finished as (select * from jobs where exit_state = 'completed' and run_time > 0),
preds as (select job_id, jnam, edt, run_time as act, elpl as req, m.model,
  case m.model when 'request_half' then elpl * 0.5::double
       else run_time * (0.7::double + (job_id % 13) / 20.0::double) end as pred
  from finished cross join (values ('request_half'), ('scaled_actual')) m(model)),
windows3 as (select ws as window_start, ws + interval 3 day as window_end from
  (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-28', interval 3 day)) as ws)),
windows9 as (select window_start, window_start + interval 9 day as window_end from windows3),
window_preds as (select job_id, jnam, act, req, model, pred + b.buffer as pred, 3 as window_size,
  window_start, b.bias from preds join windows3 on edt >= window_start and edt < window_end
  cross join (values ('none', 0.0::double), ('two_sigma', 1800.0::double)) b(bias, buffer))
"""
