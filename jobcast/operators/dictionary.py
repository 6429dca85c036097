"""Category codes that can be applied again: a dictionary in published versions, which grows and never changes a code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.operators.encode import SLOTS, attach_code, slot_of
from jobcast.operators.scaling import BROADCAST_BYTES, BROADCAST_ROWS, number_sorted
from jobcast.sources.versions import Versions

ENTRY = ("column", *SLOTS)


def as_categories(df: DataFrame, cols: Sequence[str], as_string: bool) -> DataFrame:
    """NaN becomes a missing value; with ``as_string`` values become text and a missing one the text ``nan``."""
    floats = [c for c in cols if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols}) if as_string else df


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, long, double, string, n): the different values of each column, a missing one without any; one pass."""
    slots = {c: slot_of(df.schema[c].dataType) for c in cols}
    entries = F.array(*[F.struct(F.lit(c).alias("column"), *[
        (F.col(c) if slot == slots[c] else F.lit(None)).cast(slot).alias(slot) for slot in SLOTS]) for c in cols])
    return df.select(F.inline(entries)).groupBy(*ENTRY).agg(F.count("*").alias("n"))


def grow_dictionary(df: DataFrame, cols: Sequence[str], root: str, as_string: bool = False) -> str:
    """Add the values of ``df`` that the dictionary under ``root`` lacks, and return the name of its newest version.

    The first batch's values get the codes that ``label_encode`` gives: 0-based places in sorted order, a missing value last
    (or the text ``nan`` with ``as_string``). Later values go behind all codes of their column, those of one batch in sorted
    order. Codes never change and are never used twice, so whatever was encoded or trained with an older version stays
    right. A batch without new values makes no version. One writer at a time; readers need not wait for it.
    """
    spark, versions = df.sparkSession, Versions(df.sparkSession, root)
    newest = versions.newest()
    seen = categories(as_categories(df, cols, as_string), cols)
    known = versions.table("entries", newest) if newest else None
    if known is not None:
        same = reduce(lambda a, b: a & b, [seen[c].eqNullSafe(known[c]) for c in ENTRY])
        seen = seen.join(known, same, "left_anti")
    new, n_new = number_sorted(seen, list(ENTRY), "new-categories", "__place")
    if not n_new and newest:
        return newest
    # one row per column
    added = dict(new.groupBy("column").agg(F.count("*")).collect())
    codes = dict(known.groupBy("column").agg(F.max("code") + 1).collect()) if known is not None else {}
    order = sorted(added)
    starts = dict(zip(order, [0, *accumulate(added[c] for c in order)]))
    shift = F.coalesce(*[F.when(F.col("column") == c, F.lit(codes.get(c, 0) - starts[c])) for c in order], F.lit(0))
    entries = new.select(*ENTRY, "n", (F.col("__place") + shift).cast("long").alias("code"), F.lit(as_string).alias("as_string"))
    version = versions.begin()
    (entries if known is None else known.unionByName(entries)).write.parquet(f"{versions.folder(version)}/entries")
    versions.publish(version)
    return version


def encode_with(df: DataFrame, cols: Sequence[str], root: str, version: str | None = None, unknown: int = -1,
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with codes in place of the values of ``cols``, from the dictionary's newest or the given version.

    A value that the dictionary does not know gets ``unknown``. Small columns' entries are broadcast after their rows and text
    have been counted; of larger ones the most frequent are, and the rest is joined by shuffle, spread where it is not needed.
    """
    versions = Versions(df.sparkSession, root)
    entries = versions.table("entries", version or versions.newest())
    # one row per column
    told = {r["column"]: r for r in entries.groupBy("column").agg(
        F.first("as_string").alias("as_string"), F.count("*").alias("size"), F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("bytes"),
        F.max(F.when(F.coalesce(*[F.col(s).cast("string") for s in SLOTS]).isNull(), F.col("code"))).alias("missing")).collect()}
    lacking = [c for c in cols if c not in told]
    if lacking:
        raise ValueError(f"the dictionary has no columns {lacking}")
    for c in cols:
        own = as_categories(df, [c], told[c]["as_string"])
        slot = slot_of(own.schema[c].dataType)
        values = entries.where((F.col("column") == c) & F.col(slot).isNotNull()).select(F.col(slot).alias("value"), "n", "code")
        small = told[c]["size"] <= max_rows and told[c]["bytes"] <= BROADCAST_BYTES
        coded = attach_code(own, c, values, small, "__code_of")
        missing = F.when(F.col(c).isNull(), F.lit(told[c]["missing"]))
        df = coded.withColumn(c, F.coalesce("__code_of", missing, F.lit(unknown)).cast("long")).drop("__code_of")
    return df
