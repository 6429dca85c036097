"""Category codes, first-appearance ids, row numbers and orderings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.operators.scaling import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, number_sorted

HOT_ENTRIES = 1000
HOT_BYTES = BROADCAST_BYTES // HOT_ENTRIES
HASH_SPREAD = 4096


def split_hash32(key: str, seed: int):
    """The 32-bit number behind hash splits and samples: the same on every engine and run; a missing key counts as an empty one."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def attach_code(df: DataFrame, col: str, dictionary: DataFrame, small: bool, out: str) -> DataFrame:
    """Add the code of ``col`` from a table ``(value, n, code)``; no code for NULL.

    A small dictionary is broadcast. A large one is joined by shuffle after
    its most frequent entries, at most ``HOT_ENTRIES``, have been broadcast:
    rows they cover are spread evenly instead of following their hot value.
    """
    value = F.col(col)
    if small:
        entries = dictionary.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        return df.join(F.broadcast(entries), value == F.col("__value"), "left").withColumn(
            out, F.col("__code")).drop("__value", "__code")
    short = F.octet_length(F.col("value").cast("string")) <= HOT_BYTES
    hot = dictionary.where(short).orderBy(F.desc("n"), "code").limit(HOT_ENTRIES).select(
        F.col("value").alias("__hot"), F.col("code").alias("__hot_code"))
    rest = dictionary.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    marked = df.join(F.broadcast(hot), value == F.col("__hot"), "left").withColumns({
        "__open": F.when(F.col("__hot_code").isNull(), value),
        "__spread": F.when(F.col("__hot_code").isNull() & value.isNotNull(), F.lit(-1)).otherwise(
            F.pmod(F.xxhash64(*df.columns), F.lit(HASH_SPREAD)).cast("int")),
    })
    joined = marked.join(rest.withColumn("__side", F.lit(-1)), (F.col("__open") == F.col("__value"))
                         & (F.col("__spread") == F.col("__side")), "left")
    return joined.withColumn(out, F.coalesce("__hot_code", "__code")).drop(
        "__hot", "__hot_code", "__open", "__spread", "__value", "__code", "__side")


SLOTS = ("long", "double", "string")


def slot_of(kind: T.DataType) -> str:
    """The dictionary column that keeps values of this type in their own order."""
    if isinstance(kind, T.IntegralType):
        return "long"
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "string"


def label_encode(df: DataFrame, cols: Sequence[str], as_string: bool = False,
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each category becomes its 0-based place among the sorted values of its column.

    With ``as_string`` values are ordered as text and a missing one is the text
    ``nan``; otherwise they keep their own order and a missing one comes last.
    NaN is a missing value too. One pass over the trace collects the categories of all columns.
    """
    floats = [c for c in cols if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
    if as_string:
        df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols})
    slots = {c: slot_of(df.schema[c].dataType) for c in cols}
    entries = F.array(*[F.struct(F.lit(i).alias("which"), *[
        (F.col(c) if slot == slots[c] else F.lit(None)).cast(slot).alias(slot) for slot in SLOTS]) for i, c in enumerate(cols)])
    order = ["which", *SLOTS]
    present = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in SLOTS])
    values = df.select(F.inline(entries)).where(present).groupBy(*order).agg(F.count("*").alias("n"))
    numbered, _ = number_sorted(values, order, "categories", "place")
    measured = numbered.groupBy("which").agg(
        F.count("*").alias("size"), F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("bytes")).collect()
    sizes = {r["which"]: r["size"] for r in measured}
    small = {r["which"] for r in measured if r["size"] <= max_rows and r["bytes"] <= BROADCAST_BYTES}
    starts = [0, *accumulate(sizes.get(i, 0) for i in range(len(cols)))]
    for i, c in enumerate(cols):
        own = numbered.where(F.col("which") == i).select(
            F.col(slots[c]).alias("value"), "n", (F.col("place") - starts[i]).alias("code"))
        coded = attach_code(df, c, own, i in small, "__new_" + c)
        df = coded.withColumn(c, F.coalesce("__new_" + c, F.lit(sizes.get(i, 0)))).drop("__new_" + c)
    return df


def first_seen_id(df: DataFrame, col: str, order_cols: Sequence[str], out: str | None = None,
                  default: int = -1, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """1-based ids of the values of ``col`` in order of first appearance; NULL gives ``default``."""
    firsts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.min(F.struct(*order_cols)).alias("first"), F.count("*").alias("n"))
    numbered, _ = number_sorted(firsts, ["first", "value"], "first-seen", "place")
    entries = numbered.select("value", "n", (F.col("place") + 1).alias("code"))
    out = out or col + "_id"
    return attach_code(df, col, entries, fits_broadcast(entries, max_rows), "__id").withColumn(
        out, F.coalesce("__id", F.lit(default))).drop("__id")


def sequential_job_number(df: DataFrame, order_cols: Sequence[str], out: str = "job_number") -> DataFrame:
    """1..n in the given order, which must end in a unique key."""
    numbered, _ = number_sorted(df, list(order_cols), "numbered", "__place")
    return numbered.withColumn(out, F.col("__place") + 1).drop("__place")


def sort_trace(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ascending, missing values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def random_sample_n(df: DataFrame, key: str, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, shown in key order; a top-n, not a sort of the trace."""
    return df.orderBy(split_hash32(key, seed), key).limit(n).orderBy(key)


def wcss_second_diff(curves: DataFrame, by: Sequence[str] = ("window_start",)) -> DataFrame:
    """First and second differences along ``k`` of each curve ``(by..., k, wcss)``."""
    along = Window.partitionBy(*by).orderBy("k")
    step = F.lead("wcss").over(along) - F.col("wcss")
    return curves.withColumns({"first_diff": step}).withColumn(
        "second_diff", F.lead("first_diff").over(along) - F.col("first_diff"))


def elbow_k(curves: DataFrame, by: Sequence[str] = ("window_start",), tolerance: float = 0.0) -> DataFrame:
    """Place of the first negative second difference plus 2; none at all gives 2.

    A difference counts as negative beyond ``tolerance`` times the curve's largest value.
    """
    along = Window.partitionBy(*by).orderBy("k")
    placed = wcss_second_diff(curves, by).withColumns({
        "__place": F.row_number().over(along) - 1, "__least": F.max("wcss").over(Window.partitionBy(*by)) * -tolerance})
    return placed.groupBy(*by).agg((F.coalesce(
        F.min(F.when(F.col("second_diff") < F.col("__least"), F.col("__place"))), F.lit(0)) + 2).alias("elbow_k"))


def silhouette_k(curves: DataFrame, by: Sequence[str] = ("window_start",)) -> DataFrame:
    """``k`` with the highest silhouette, the smallest on ties."""
    return curves.groupBy(*by).agg(
        F.max(F.struct(F.col("silhouette"), (-F.col("k")).alias("minus_k"))).alias("top")).select(
        *by, (-F.col("top.minus_k")).alias("silhouette_k"))
