"""Aggregates over prediction frames ``(..., pred, act, req)`` and over jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.functions.scalar import inf_to_null
from jobcast.operators.quantiles import REST, exact_quantile
from jobcast.operators.scaling import attach, attach_group_stats
from jobcast.session import store

# Buffers added to a prediction.
BIAS_TYPES = ("none", "mean", "mad", "std_dev", "two_sigma")
# Requested-time bins in minutes, and their labels.
REQUEST_BINS = (0, 10, 60, 120, 240, 480, 960, 1440, 2880, 5760, 11520, 23040)
REQUEST_LABELS = ("0-10min", "10min-1hr", "1hr-2hrs", "2hrs-4hrs", "4hrs-8hrs", "8hrs-16hrs",
                  "16hrs-1day", "1day-2days", "2days-4days", "4days-8days", "8days-16days")
# Actual-time ranges in seconds, and the decades and bin count of the error histogram.
ACT_BOUNDS = (0, 3600, 21600, 43200, 86400, 172800)
HIST_FROM, HIST_TO, HIST_BINS = -3, 4, 49

EXPERIMENT_KEYS = ("window_size", "window_start", "model", "bias")


def gap() -> Column:
    return F.col("act") - F.col("pred")


def is_under() -> Column:
    return F.col("pred") < F.col("act")


def count_jobs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_jobs"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def min_max(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in cols
                                 for n, f in (("min", F.min), ("max", F.max))])


def bin_counts(df: DataFrame, bin_col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, bin_col).agg(F.count("*").alias("n"))


def rmse_of() -> Column:
    return F.sqrt(F.avg(gap() * gap()))


def rmse(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by).agg(rmse_of().alias("rmse"))


def mae(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(F.abs(gap())).alias("mae"))


def r2_score(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 - SSE / SST; NULL when all actual values are equal."""
    return preds.groupBy(*by).agg((F.lit(1.0) - F.try_divide(
        F.sum(gap() * gap()), F.var_pop("act") * F.count("act"))).alias("r2"))


def under_ratio_of() -> Column:
    return F.lit(100.0) * F.count_if(is_under()) / F.count("*")


def under_amounts_of() -> list[Column]:
    """Total, mean and sample deviation of the shortfalls in hours; none at all sums to 0."""
    short = F.when(is_under(), gap())
    return [
        (F.coalesce(F.sum(short), F.lit(0.0)) / 3600.0).alias("ur_total_hours"),
        (F.avg(short) / 3600.0).alias("ur_mean_hours"),
        (F.stddev_samp(short) / 3600.0).alias("ur_std_hours"),
    ]


def underpred_ratio(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by).agg(under_ratio_of().alias("ur"))


def underpred_amounts(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    return preds.groupBy(*by).agg(*under_amounts_of())


def window_metrics(preds: DataFrame, by: Sequence[str] = EXPERIMENT_KEYS) -> DataFrame:
    """All per-window metrics in one aggregate."""
    return preds.groupBy(*by).agg(
        rmse_of().alias("rmse"), F.avg(F.abs(gap())).alias("mae"),
        under_ratio_of().alias("ur"), *under_amounts_of())


def average_metrics(metrics: DataFrame, by: Sequence[str] = ("window_size", "model", "bias")) -> DataFrame:
    """Plain mean of the window metrics; a missing one is left out of its mean."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias("avg_" + c) for c in (
        "rmse", "mae", "ur", "ur_total_hours", "ur_mean_hours", "ur_std_hours")])


def rounded_up(preds: DataFrame, ceil: bool) -> DataFrame:
    return preds.withColumn("pred", F.ceil("pred").cast("double")) if ceil else preds


def pooled_success_rate(preds: DataFrame, ceil: bool = False,
                        by: Sequence[str] = ("model", "bias")) -> DataFrame:
    """Percent of jobs with a large enough prediction, over all windows together."""
    pooled = rounded_up(preds, ceil).groupBy(*by).agg(
        F.count("*").alias("n_jobs"), F.count_if(is_under()).alias("n_under"))
    share = F.when(F.col("n_jobs") > 0, F.lit(100.0) * F.col("n_under") / F.col("n_jobs"))
    return pooled.withColumns({
        "success_rate": F.coalesce(F.lit(100.0) - share, F.lit(0.0)),
        "under_rate": F.coalesce(share, F.lit(0.0)),
    })


def over_totals_of() -> list[Column]:
    return [
        (F.coalesce(F.sum(F.when(F.col("act") < F.col("req"), F.col("req") - F.col("act"))),
                    F.lit(0.0)) / 3600.0).alias("user_over_hours"),
        (F.coalesce(F.sum(F.when(F.col("act") < F.col("pred"), F.col("pred") - F.col("act"))),
                    F.lit(0.0)) / 3600.0).alias("model_over_hours"),
    ]


def overprediction_totals(preds: DataFrame, by: Sequence[str] = ("model",), ceil: bool = False) -> DataFrame:
    return rounded_up(preds, ceil).groupBy(*by).agg(*over_totals_of())


def underpred_bias(val_preds: DataFrame, by: Sequence[str], approx: bool = False, rest: int = REST) -> DataFrame:
    """Buffers learned from shortfalls: mean, median absolute deviation, deviation, twice that.

    Groups without a shortfall keep a row with ``n_under`` 0 and NULL buffers.
    """
    by = list(by)
    short = F.when(F.col("act") > F.col("pred"), gap())
    base = val_preds.groupBy(*by).agg(
        F.avg(short).alias("mean"), F.stddev_pop(short).alias("std_dev"), F.count(short).alias("n_under"))
    # Both medians read the shortfalls alone.
    shortfalls = store(val_preds.select(*by, short.alias("short")).where(F.col("short").isNotNull()), "shortfalls")
    middle = exact_quantile(shortfalls, "short", by, 0.5, "middle", approx, rest)
    if by:
        centred = attach(shortfalls, store(middle, "shortfall-median"), by)
    else:
        centred = shortfalls.withColumn("middle", middle.scalar())
    off = centred.select(*by, F.abs(F.col("short") - F.col("middle")).alias("off"))
    spread = exact_quantile(off, "off", by, 0.5, "mad", approx, rest)
    joined = attach(base, store(spread, "shortfall-mad"), by) if by else base.withColumn("mad", spread.scalar())
    return joined.select(*by, "mean", "mad", "std_dev", (F.col("std_dev") * 2).alias("two_sigma"), "n_under")


def apply_bias(preds: DataFrame, biases: DataFrame, bias_types: Sequence[str],
               by: Sequence[str]) -> DataFrame:
    """One row per prediction and buffer, from a single scoring; a missing buffer counts as 0."""
    unknown = [b for b in bias_types if b not in BIAS_TYPES]
    if unknown:
        raise ValueError(f"unknown bias types: {unknown}; choose from {list(BIAS_TYPES)}")
    table = biases.select(*by, *[F.col(b).alias("__" + b) for b in BIAS_TYPES[1:]])
    if by:
        joined = attach(preds, store(table, "biases"), list(by))
    else:
        one = table.select(F.struct("*").alias("s")).scalar()
        joined = preds.select("*", one.alias("__s")).select(*preds.columns, "__s.*")
    choices = F.array(*[F.struct(
        F.lit(b).alias("bias"),
        (F.lit(0.0) if b == "none" else F.coalesce(F.col("__" + b), F.lit(0.0))).alias("buffer"),
    ) for b in bias_types])
    keep = [c for c in preds.columns if c != "pred"]
    return joined.withColumn("__choice", F.explode(choices)).select(
        *keep, F.col("__choice.bias").alias("bias"), (F.col("pred") + F.col("__choice.buffer")).alias("pred"))


def group_mean_predictor(train: DataFrame, test: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """The mean target of the row's group as its prediction; groups without training rows are left out."""
    means = train.groupBy(*by).agg(F.avg(target).alias("pred"))
    return attach(test, store(means, "group-means"), list(by), how="inner").withColumn("act", F.col(target))


def wait_by_request_bin(df: DataFrame, bins: Sequence[float] = REQUEST_BINS,
                        labels: Sequence[str] = REQUEST_LABELS,
                        request_min: str = "wallclock_req_min", wait_hours: str = "wait_hours") -> DataFrame:
    """Mean wait per right-closed bin of requested time; empty bins are kept."""
    spark = df.sparkSession
    c = F.col(request_min)
    place = F.when(c <= bins[0], F.lit(None))
    for i, upper in enumerate(bins[1:]):
        place = place.when(c <= upper, F.lit(i))
    means = df.groupBy(place.alias("bin_id")).agg(F.avg(wait_hours).alias("mean_wait_hours"),
                                                  F.count("*").alias("n_jobs"))
    dim = spark.createDataFrame(list(enumerate(labels)), "bin_id int, label string")
    return dim.join(means, "bin_id", "left").withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)))


def act_range(act: Column, bounds: Sequence[float]) -> Column:
    """Index of the right-closed range holding ``act``; NULL outside all."""
    place = F.when(act <= bounds[0], F.lit(None))
    for i, upper in enumerate(bounds[1:]):
        place = place.when(act <= upper, F.lit(i))
    return place


def error_histogram(preds: DataFrame, by: Sequence[str], bounds: Sequence[float] = ACT_BOUNDS) -> DataFrame:
    """Absolute errors in minutes, in log-spaced bins per actual-time range."""
    x = F.abs(gap()) / 60.0
    top = 10.0 ** HIST_TO
    slot = F.when(x == top, F.lit(HIST_BINS).cast("long")).when(x > 0, F.width_bucket(
        F.log10(x), F.lit(float(HIST_FROM)), F.lit(float(HIST_TO)), F.lit(HIST_BINS)))
    placed = preds.select(*by, act_range(F.col("act"), bounds).alias("act_range"), slot.alias("error_bin"))
    return placed.where(F.col("act_range").isNotNull() & F.col("error_bin").between(1, HIST_BINS)).groupBy(
        *by, "act_range", "error_bin").agg(F.count("*").alias("n_jobs"))


def median_error_by_range(preds: DataFrame, bounds: Sequence[float] = ACT_BOUNDS,
                          by: Sequence[str] = ("model",), window: str = "window_start",
                          approx: bool = False, rest: int = REST) -> DataFrame:
    """Median absolute error in minutes per window and range, then the median over windows."""
    ranged = preds.select(*by, window, act_range(F.col("act"), bounds).alias("act_range"),
                          (F.abs(gap()) / 60.0).alias("abs_error")).where(F.col("act_range").isNotNull())
    per_window = exact_quantile(ranged, "abs_error", [*by, window, "act_range"], 0.5, "window_median", approx, rest)
    limits = F.array(*[F.lit(int(b)) for b in bounds])
    # One row per window is left here.
    return per_window.groupBy(*by, "act_range").agg(
        F.median("window_median").alias("median_error_min")).select(
        *by, "act_range", F.get(limits, F.col("act_range")).alias("range_from"),
        F.get(limits, F.col("act_range") + 1).alias("range_to"), "median_error_min")


def boxplot_stats(metrics: DataFrame, value_cols: Sequence[str],
                  by: Sequence[str] = ("window_size", "model", "bias")) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and outliers, per metric.

    ``metrics`` has one row per window and setting, so a group is as small as the window list.
    """
    by = list(by)
    tall = metrics.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in value_cols]))).where(
        F.col("value").isNotNull())
    keys = [*by, "metric"]
    quarts = tall.groupBy(*keys).agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    bounded = attach(tall, store(quarts, "quartiles"), keys).withColumns({
        "q1": F.col("q")[0], "median": F.col("q")[1], "q3": F.col("q")[2]}).withColumns({
            "lo": F.col("q1") - (F.col("q3") - F.col("q1")) * 1.5,
            "hi": F.col("q3") + (F.col("q3") - F.col("q1")) * 1.5})
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    return bounded.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


KERNEL_REACH = 38.6  # a Gaussian this many bandwidths away is zero in doubles


def kde_density(df: DataFrame, col: str, by: Sequence[str], grid: int = 200, cut: float = 3.0,
                reach: float = KERNEL_REACH) -> DataFrame:
    """Gaussian density of ``log10(col)`` on an even grid, Scott bandwidth, per group.

    Equal values are counted first and add once, to the grid points within ``reach`` bandwidths. The default leaves
    out only terms that are zero in doubles; a smaller reach r is cheaper, and each density is then too low by at most
    exp(-r * r / 2) over the bandwidth times sqrt(2 pi).
    """
    by = list(by)
    logs = df.where(F.col(col) > 0).select(*by, F.log10(col).alias("__x"))
    stats = [F.count("*").alias("__n"), F.stddev_samp("__x").alias("__sd"),
             F.min("__x").alias("__min"), F.max("__x").alias("__max")]
    width = F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))
    frame = store(
        logs.groupBy(*by).agg(*stats).where((F.col("__n") > 1) & (F.col("__sd") > 0))
        .withColumn("__bw", width)
        .withColumn("__lo", F.col("__min") - F.col("__bw") * cut)
        .withColumn("__step", (F.col("__max") + F.col("__bw") * cut - F.col("__lo")) / F.lit(grid - 1)),
        "kde-grid")
    wide = attach(logs.groupBy(*by, "__x").agg(F.count("*").alias("__times")), frame, by, how="inner")
    reach = F.col("__bw") * reach
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("__x") - reach - F.col("__lo")) / F.col("__step")))
    last = F.least(F.lit(grid - 1).cast("long"), F.floor((F.col("__x") + reach - F.col("__lo")) / F.col("__step")))
    touched = wide.where(first <= last).withColumn("grid_id", F.explode(F.sequence(first, last)))
    at = F.col("__lo") + F.col("__step") * F.col("grid_id")
    z = (at - F.col("__x")) / F.col("__bw")
    sums = touched.groupBy(*by, "grid_id").agg(F.sum(F.exp(z * z * -0.5) * F.col("__times")).alias("__s"))
    points = frame.withColumn("grid_id", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
    height = F.coalesce("__s", F.lit(0.0)) / (F.col("__n") * F.col("__bw") * F.sqrt(F.lit(2.0) * F.pi()))
    return points.join(sums, [*by, "grid_id"], "left").select(
        *by, "grid_id", at.alias("log10_x"), height.alias("density"))


def mean_impute(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing, NaN and infinite values become the column's mean over its finite values."""
    clean = inf_to_null(df, cols)
    stats = [F.avg(c).alias("__mean_" + c) for c in cols]
    wide = attach_group_stats(clean, stats, list(by), "means")
    return wide.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("__mean_" + c)) for c in cols}).drop(
        *["__mean_" + c for c in cols])


def minmax_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column becomes 0."""
    stats = [f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    wide = attach_group_stats(df, stats, list(by), "ranges")

    def scaled(c: str) -> Column:
        lo, hi = F.col("__lo_" + c).cast("double"), F.col("__hi_" + c).cast("double")
        return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0)))

    return wide.withColumns({c: scaled(c) for c in cols}).drop(
        *[f"__{n}_{c}" for c in cols for n in ("lo", "hi")])
