"""Train and test splits, target bins and balanced resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobcast.operators.encode import split_hash32
from jobcast.operators.scaling import attach, attach_group_stats, first_by_hash, rank_in_groups
from jobcast.session import store
from jobcast.spec import TraceSpec

CHUNK = 100_000
DRAWS_PER_KEY = 1000


def split_hash(df: DataFrame, key: str, test_fraction: float, seed: int, out: str = "is_test") -> DataFrame:
    """A repeatable random split from the row's key alone: no shuffle, no state."""
    return df.withColumn(out, split_hash32(key, seed) % 10000 < F.lit(round(test_fraction * 10000)))


def split_exact(df: DataFrame, key: str, by: Sequence[str], test_fraction: float, seed: int,
                out: str = "is_test") -> DataFrame:
    """Exactly ``ceil(test_fraction * n)`` test rows of each group, chosen by hash order.

    Keys tell rows apart, so a missing one fails the job.
    """
    df = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"split_exact needs a {key} in every row")).cast(
        df.schema[key].dataType)))
    wanted = F.ceil(F.lit(float(test_fraction)) * F.col("__size"))
    return first_by_hash(df, by, split_hash32(key, seed), key, wanted, "__size", out)


def split_success_failure(df: DataFrame, spec: TraceSpec) -> DataFrame:
    """Both disjoint tables as one frame with an ``outcome`` column, from one scan."""
    ok = (F.col(spec.state) == spec.success) & ~F.col(spec.run_time).eqNullSafe(F.lit(0.0))
    outcome = F.when(ok, F.lit("success"))
    if spec.failure is not None:
        outcome = outcome.when(F.col(spec.state) == spec.failure, F.lit("failure"))
    return df.withColumn("outcome", outcome).where(F.col("outcome").isNotNull())


def split_by_cluster(df: DataFrame, cluster: int) -> DataFrame:
    return df.where(F.col("cluster") == cluster)


def concat_frames(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def bin_of(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 0..n-1 on [lo, hi); the maximum falls in an extra bin n."""
    return F.when(value == hi, F.lit(n)).otherwise(
        F.least(F.floor((value - lo) * n / F.nullif(hi - lo, F.lit(0.0))), F.lit(n - 1))).cast("int")


def equal_width_bins(df: DataFrame, col: str, by: Sequence[str], n: int = 10, out: str = "bin") -> DataFrame:
    bounded = attach_group_stats(
        df, [F.min(col).alias("__lo"), F.max(col).alias("__hi")], list(by), "bin-bounds")
    return bounded.withColumn(out, bin_of(F.col(col), F.col("__lo"), F.col("__hi"), n)).drop("__lo", "__hi")


def bin_sizes(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per bin and the size of the group's largest bin; at most 11 rows per group."""
    sizes = binned.groupBy(*by, "bin").agg(F.count("*").alias("bin_n"))
    return sizes.withColumn("max_bin", F.max("bin_n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def balanced_resample(df: DataFrame, target: str, by: Sequence[str], key: str,
                      n_bins: int = 10, seed: int = 42) -> DataFrame:
    """Draw with replacement until each non-empty target bin has the size of its group's largest.

    Draw ``j`` of a bin takes the row whose place in the bin comes from a hash
    of (group, bin, j). The join key is the place, not the bin, so a bin that holds most rows is spread. In a bin of few
    rows each is drawn often: there every row is repeated under several salts, and draws are dealt over these, so that
    no key gets more than about ``DRAWS_PER_KEY`` draws on average. Bin, place and salt are two numbers in the join, which
    sorts both sides: the draws come from a few rows of sizes, and Spark would take them for few and gather them for a broadcast.
    """
    by = list(by)
    keys = [*by, "bin"]
    rows = df.where(F.col(target).isNotNull())
    binned = equal_width_bins(rows, target, by, n_bins)
    placed = rank_in_groups(binned, keys, split_hash32(key, seed), [key], "__place", "__size").drop("__size")
    salts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("max_bin") / (F.col("bin_n") * F.lit(DRAWS_PER_KEY))))
    sizes = store(bin_sizes(binned, by).withColumns({"__bin_id": F.monotonically_increasing_id(), "__salts": salts}), "bin-sizes")
    # a given number of partitions is kept: adaptive execution would gather the few chunks in one task, which then makes all draws
    chunks = sizes.withColumn("__chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("max_bin") - 1) / F.lit(CHUNK))))).repartition(
            int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__chunk", "__bin_id")
    draws = chunks.withColumn("draw", F.explode(F.sequence(
        F.col("__chunk") * CHUNK + 1, F.least(F.col("max_bin"), (F.col("__chunk") + 1) * CHUNK))))
    first = (F.col("__place") - 1) * F.col("__salts")
    placed = attach(placed, sizes.select(*keys, "__bin_id", "__salts"), keys).withColumn(
        "__slot", F.explode(F.sequence(first, first + F.col("__salts") - 1))).drop("__place", "__salts")
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys],
                       F.col("draw").cast("string"), F.lit(str(seed)))
    pick = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.col("bin_n")
    picked = draws.select("__bin_id", (pick * F.col("__salts") + F.col("draw") % F.col("__salts")).alias("__slot"), "draw")
    return placed.join(picked.hint("merge"), ["__bin_id", "__slot"]).drop("__bin_id", "__slot")


def balance_weights(df: DataFrame, target: str, by: Sequence[str], n_bins: int = 10,
                    out: str = "weight") -> DataFrame:
    """The resampling's expected weight of each row: largest bin over own bin. No row is copied."""
    by = list(by)
    binned = equal_width_bins(df.where(F.col(target).isNotNull()), target, by, n_bins)
    weights = bin_sizes(binned, by).select(
        *by, "bin", (F.col("max_bin") / F.col("bin_n")).alias(out))
    return attach(binned, store(weights, "bin-weights"), [*by, "bin"])
