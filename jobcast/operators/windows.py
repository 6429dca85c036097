"""Time windows and the joins that go with them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.functions.scalar import seconds_between
from jobcast.operators.scaling import attach, fits_broadcast
from jobcast.session import store

DAY = 86400


def window_table(spark: SparkSession, start: str, end: str, size_days: int, step: str) -> DataFrame:
    """Half-open windows of ``size_days`` whose starts run from ``start`` to ``end``.

    ``step`` is a number of days (``3D``) or ``1M`` for month ends.
    """
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    if step.upper() == "1M":
        clock = first - F.to_date(first).cast("timestamp_ntz")
        months = F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"),
                                      F.expr("interval 1 month")))
        starts = (spark.range(1).select(months.alias("m"), clock.alias("clock"))
                  .select((F.last_day("m").cast("timestamp_ntz") + F.col("clock")).alias("window_start")))
    elif step.upper().endswith("D") and step[:-1].isdigit() and int(step[:-1]) > 0:
        starts = spark.range(1).select(F.explode(F.sequence(
            first, last, F.expr(f"interval {int(step[:-1])} day"))).alias("window_start"))
    else:
        raise ValueError(f"step must look like '3D' or be '1M', not {step!r}")
    return starts.where((F.col("window_start") >= first) & (F.col("window_start") <= last)).withColumn(
        "window_end", F.col("window_start") + F.expr(f"interval {int(size_days)} day"))


def assign_windows_tumbling(df: DataFrame, ts: str, size_days: int, start: str,
                            last_start: str | None = None) -> DataFrame:
    """The one window holding ``ts``, by arithmetic: neither join nor shuffle."""
    origin = F.lit(start).cast("timestamp_ntz")
    at = F.col(ts).cast("timestamp_ntz")
    length = int(size_days) * DAY
    number = F.floor(seconds_between(origin, at) / F.lit(length))
    begin = F.timestamp_add("SECOND", number * length, origin)
    placed = df.where(at >= origin).withColumn("window_start", begin).withColumn(
        "window_end", F.col("window_start") + F.expr(f"interval {int(size_days)} day"))
    if last_start is not None:
        placed = placed.where(F.col("window_start") <= F.lit(last_start).cast("timestamp_ntz"))
    return placed


def assign_windows_sliding(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """Every window with ``window_start <= ts < window_end``; one output row per match.

    Windows are listed under each day they touch, so that the range condition
    becomes an equi-join on the day and only candidates of that day are compared.
    """
    days = windows.withColumn("__day", F.explode(F.sequence(
        F.to_date("window_start"), F.to_date(F.col("window_end") - F.expr("interval 1 microsecond")),
        F.expr("interval 1 day"))))
    side = F.broadcast(days) if fits_broadcast(days) else days
    at = df[ts].cast("timestamp_ntz")
    return df.join(side, (F.to_date(at) == days["__day"])
                   & (at >= days["window_start"]) & (at < days["window_end"])).drop("__day")


def squared_distance(features: Sequence[Column], center: Column) -> Column:
    return reduce(lambda a, b: a + b, [
        (f.cast("double") - center[i]) * (f.cast("double") - center[i]) for i, f in enumerate(features)])


def center_array(centers: Sequence[Sequence[float]]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(x)) for x in c]).alias("center"))
        for i, c in enumerate(centers)])


def nearest_center(df: DataFrame, features: Sequence[str], centers, by: Sequence[str] = (),
                   out: str = "cluster") -> DataFrame:
    """Nearest centre by Euclidean distance, lowest id on ties, NULL if a feature is missing.

    ``centers`` is a list of coordinate lists, compared as a literal, or a
    table ``(by..., cluster, center)``: the few centres of a group are packed in
    one array, so that rows meet them by an equi-join and are not multiplied.
    """
    cols = [F.col(f) for f in features]
    if isinstance(centers, DataFrame):
        pairs = centers.select(*by, F.struct(F.col("cluster").cast("int").alias("cluster"), "center").alias("c"))
        packed = pairs.groupBy(*by).agg(F.collect_list("c").alias("__centers"))
        if by:
            df = attach(df, store(packed, "centers"), list(by))
        else:
            df = df.withColumn("__centers", packed.scalar())
        choices = F.col("__centers")
    else:
        choices = center_array(centers)
    scored = F.transform(choices, lambda c: F.struct(
        squared_distance(cols, c["center"]).alias("d"), c["cluster"].alias("cluster")))
    complete = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c.cast("double")) for c in cols])
    return df.withColumn(out, F.when(complete, F.array_min(scored)["cluster"])).drop("__centers")


def lookup_join(df: DataFrame, dim: DataFrame, key: str, default: float = -1) -> DataFrame:
    """Columns of ``dim`` for each row's ``key``; unknown keys get ``default``."""
    values = [c for c in dim.columns if c != key]
    joined = attach(df, dim, [key])
    fills = {c: F.coalesce(F.col(c), F.lit(default)) for c in values
             if isinstance(dim.schema[c].dataType, T.NumericType)}
    return joined.withColumns(fills) if fills else joined
