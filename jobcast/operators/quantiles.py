"""Exact quantiles of groups of any size, by narrowing the values between which the wanted rank lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.operators.scaling import attach
from jobcast.session import store

# A round leaves about three of so many equal parts of a group; the sketch is exact to a fraction of a part.
STEPS = 256
ACCURACY = 10_000
# Values of a group that are put in order at last: the most that a task holds of it.
REST = 10_000


def narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """One round for the groups of ``state``: a sketch of the values still open, new bounds from it, exact counts for these.

    ``state`` has, besides the keys, ``n`` rows in all, the bounds ``lo`` and ``hi`` (none at first), the rows ``below`` the lower one,
    ``at_lo`` on it and ``mid`` strictly between the two. The wanted ranks ``low`` and ``high`` stay within the closed bounds.
    """
    still = opened(rows, state, keys)
    parts = F.percentile_approx("__v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.lit(ACCURACY))
    sketch = store(still.groupBy(*keys).agg(parts.alias("parts")), "quantile-parts")
    first, last = low - F.col("below") - F.col("at_lo"), high - F.col("below") - F.col("at_lo")
    i = F.greatest(F.floor(first * STEPS / F.col("mid")) - 1, F.lit(0))
    j = F.least(F.ceil((last + 1) * STEPS / F.col("mid")) + 1, F.lit(STEPS))
    bounds = store(attach(state, sketch, keys, "inner").select(
        *keys, "n", "lo", "below", "at_lo",
        F.when(first < 0, F.col("lo")).otherwise(F.get("parts", i.cast("int"))).alias("new_lo"),
        F.when(last >= F.col("mid"), F.col("hi")).otherwise(F.get("parts", j.cast("int"))).alias("new_hi")), "quantile-bounds")
    v, lo, hi = F.col("__v"), F.col("new_lo"), F.col("new_hi")
    counts = attach(still, bounds.select(*keys, "new_lo", "new_hi"), keys, "inner").groupBy(*keys).agg(
        F.count_if(v < lo).alias("c_below"), F.count_if(v == lo).alias("c_lo"),
        F.count_if((lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))).alias("c_mid"))
    kept = lo.eqNullSafe(F.col("lo"))  # the lower bound has not moved
    return attach(bounds, store(counts, "quantile-counts"), keys, "inner").select(
        *keys, "n", lo.alias("lo"), hi.alias("hi"),
        F.when(kept, F.col("below")).otherwise(F.col("below") + F.col("at_lo") + F.col("c_below")).alias("below"),
        F.when(kept, F.col("at_lo")).otherwise(F.col("c_lo")).alias("at_lo"), F.col("c_mid").alias("mid"))


def opened(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows strictly between their group's bounds."""
    bounded = attach(rows, state.select(*keys, "lo", "hi"), keys, "inner")
    v = F.col("__v")
    return bounded.where((F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))).select(*keys, "__v")


def exact_quantile(df: DataFrame, value: str, by: Sequence[str], p: float = 0.5,
                   out: str = "quantile", approx: bool = False, rest: int = REST) -> DataFrame:
    """One row per group with the linearly interpolated ``p`` quantile of ``value``; missing values are left out.

    Groups are counted. While one has more than ``rest`` values that can hold the wanted rank, a round finds closer bounds for it and
    counts again, exactly, what lies below them and between them; rows on a bound are only counted, so a value that many
    rows share does not stop the narrowing. At last the values between a group's bounds, at most ``rest``, are put in order. No
    task holds a whole group, and small groups take no round. ``approx`` answers from one sketch.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    if approx:
        return rows.groupBy(*by).agg(F.percentile_approx("__v", F.lit(p), F.lit(ACCURACY)).alias(out))
    keys = by or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    place = F.lit(p) * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)
    none = F.lit(None).cast(rows.schema["__v"].dataType)
    zero = F.lit(0).cast("long")
    state = store(rows.groupBy(*keys).agg(F.count("*").alias("n")).select(
        *keys, "n", none.alias("lo"), none.alias("hi"), zero.alias("below"), zero.alias("at_lo"), F.col("n").alias("mid")), "quantile-state")
    before = F.col("below") + F.col("at_lo")
    between = (high >= before) & (low < before + F.col("mid"))  # else the bounds themselves are the answer
    wide = between & (F.col("mid") > rest)
    while state.where(wide).limit(1).count():
        state = store(narrowed(rows, state.where(wide), keys, low, high).unionByName(state.where(~wide)), "quantile-state")
    values = opened(rows, state.where(between), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("values"))
    found = attach(state, store(values, "quantile-values"), keys)

    def at(rank: Column) -> Column:
        inside = F.get("values", (rank - before).cast("int"))
        return F.when(rank < before, F.col("lo")).when(rank < before + F.col("mid"), inside).otherwise(F.col("hi"))

    a, z = at(low), at(high)
    return found.select(*by, F.when(a.isNotNull() & z.isNotNull(), a + (z - a) * (place - low)).otherwise(
        F.raise_error(F.lit("quantile rank fell outside its bounds"))).alias(out))
