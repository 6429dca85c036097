"""Building blocks that keep one hot key or group from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.session import store

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
HASH_BITS = 32
SLICE_BITS = 12


def text_bytes(df: DataFrame) -> Column:
    """Total bytes of all columns whose values have no fixed size: text, and arrays, structs and maps as text."""
    def size(f: T.StructField) -> Column | None:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
        return None

    sizes = [c for c in map(size, df.schema) if c is not None]
    return reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in sizes], F.lit(0).cast("long"))


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows and their bytes; cheap on a stored or generated table."""
    head = df.limit(max_rows + 1)
    size = head.agg(F.count("*").alias("rows"), text_bytes(head).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= BROADCAST_BYTES


def attach(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``df`` to a stored table with one row per ``keys``; missing keys match each other.

    The table is broadcast only after counting its rows and text. A larger one is joined by
    shuffle, where adaptive execution splits the partitions of hot keys.
    """
    renamed = dim.select(*[F.col(c).alias("__k_" + c) if c in keys else F.col(c) for c in dim.columns])
    side = F.broadcast(renamed) if fits_broadcast(dim, max_rows) else renamed
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed["__k_" + k]) for k in keys])
    return df.join(side, on, how).drop(*["__k_" + k for k in keys])


def attach_group_stats(df: DataFrame, stats: Sequence[Column], by: Sequence[str],
                       name: str) -> DataFrame:
    """Add per-group aggregates to each row without gathering a group's rows.

    ``stats`` are aliased aggregates. Partial aggregation reduces each group
    before its shuffle; the result comes back through ``attach``, or as a
    scalar subquery when there is a single group.
    """
    if not by:
        one = df.agg(F.struct(*stats).alias("s")).scalar()
        names = df.agg(*stats).columns
        return df.select("*", one.alias("__stats")).select(
            *df.columns, *[F.col("__stats")[n].alias(n) for n in names])
    return attach(df, store(df.groupBy(*by).agg(*stats), name), by)


def number_sorted(df: DataFrame, order: Sequence[str], name: str, out: str) -> tuple[DataFrame, int]:
    """0-based positions of ``df`` in ``order`` (which must be unique), and the row count.

    No task sorts everything: rows are range-partitioned and sorted, written once
    with their place in the partition, and shifted by the sizes of the partitions before. The
    range split samples whole order tuples, so one frequent leading value is
    spread over several partitions.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    stored = store(placed, name)
    sizes = sorted((r["__part"], r["n"]) for r in
                   stored.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, before)], "__part int, __before long")
    numbered = (
        stored.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__at") + F.col("__before"))
        .drop("__part", "__at", "__before")
    )
    return numbered, before[-1]


def slice_key(by: Sequence[str]) -> Column:
    """Group and leading hash bits as one struct.

    A struct equals another with the same NULLs, so it is a join key for nullable groups too.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return F.struct(group.alias("__group"), F.shiftright("__hash", HASH_BITS - SLICE_BITS).cast("int").alias("__slice"))


def slice_starts(sliced: DataFrame, size: str) -> DataFrame:
    """Rows of the group before each slice, of the slice and of the whole group; keyed by ``__of``."""
    counts = sliced.groupBy(F.col("__key").alias("__of")).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy("__of.__group")  # at most 4096 slices per group
    return counts.select(
        "__of", "__n",
        F.coalesce(F.sum("__n").over(whole.orderBy("__of.__slice").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias(size),
    )


def rank_in_groups(df: DataFrame, by: Sequence[str], hash32: Column, tie: Sequence[str],
                   out: str = "rank", size: str = "group_size") -> DataFrame:
    """1-based rank by a 32-bit hash within each group, plus the group's size.

    The hash's leading bits cut every group into slices; slice counts give each slice's
    offset and only slices are ranked by a window. A group holding most of the rows
    is therefore spread over up to 4096 tasks, and window and join share one shuffle of the rows.
    """
    sliced = df.withColumn("__hash", hash32).withColumn("__key", slice_key(by))
    starts = slice_starts(sliced, size).drop("__n")
    local = sliced.withColumn("__local", F.row_number().over(
        Window.partitionBy("__key").orderBy("__hash", *tie)))
    return (
        local.join(starts, F.col("__key") == F.col("__of"))
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__hash", "__key", "__of", "__before", "__local")
    )


def first_by_hash(df: DataFrame, by: Sequence[str], hash32: Column, tie: str, wanted: Column,
                  size: str, out: str) -> DataFrame:
    """Flag the ``wanted`` (of the group's ``size``) rows of each group that come first by hash.

    Slice counts tell in which slice a group's last wanted row lies; only that
    slice is ordered. Its hash and key are the group's limit, with which every
    row is compared where it is: the rows are not shuffled.
    """
    by = list(by)
    sliced = df.select(*by, tie, hash32.alias("__hash")).withColumn("__key", slice_key(by))
    cut = slice_starts(sliced, size).withColumn("__rest", wanted - F.col("__before")).where(
        (F.col("__rest") > 0) & (F.col("__rest") <= F.col("__n"))).select(F.col("__of").alias("__key"), "__rest")
    near = attach(sliced, store(cut, "cut-slices"), ["__key"], how="inner")
    order = Window.partitionBy("__key").orderBy("__hash", tie)
    limits = near.withColumn("__local", F.row_number().over(order)).where(
        F.col("__local") == F.col("__rest")).select(*by, F.struct("__hash", F.col(tie).alias("__tie")).alias("__limit"))
    mine = F.struct(hash32.alias("__hash"), F.col(tie).alias("__tie"))
    if by:
        limited = attach(df, store(limits, "limits"), by)
    else:
        limited = df.withColumn("__limit", limits.scalar())
    return limited.withColumn(out, F.coalesce(mine <= F.col("__limit"), F.lit(False))).drop("__limit")
