"""Placement of rows in shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobcast.session import store

#: region -> rack -> {shard: weight}
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
SLICE_ROWS = 4096


def even_tree(shards: int, grown: int = 0) -> dict[str, dict[str, dict[int, float]]]:
    """``shards`` equal shards, two to a rack and two racks to a region. Each of ``grown`` further shards is a region of
    its own: a weight changes only there, so rows move only there."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        tree.setdefault(f"region{s // 4}", {}).setdefault(f"rack{s // 2}", {})[s] = 1.0
    for s in range(shards, shards + grown):
        tree[f"new{s}"] = {f"rack-new{s}": {s: 1.0}}
    return tree


def draw(key: Column, name: str, weight: float) -> Column:
    """Time of a child's draw: the least of all children wins with probability weight / sum of weights."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(weight))


def winner(choices: list[tuple[Column, Column]]) -> Column:
    """The second of the pair whose first is least; on a tie the earlier pair's."""
    if len(choices) == 1:
        return choices[0][1]
    least = F.least(*[c for c, _ in choices])
    return reduce(lambda rest, c: F.when(c[0] == least, c[1]).otherwise(rest), reversed(choices[:-1]), choices[-1][1])


def place(key: Column, tree: Tree) -> Column:
    """Shard of a key: a weighted draw among regions, then among the region's racks, then among the rack's shards.

    A node weighs what its shards weigh, zero weights take nothing. A draw depends on the key and the child alone, so
    a changed weight moves rows only between that child and its siblings.
    """
    weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(draw(key, f"shard/{s}", w), F.lit(s)) for s, w in shards.items() if w > 0]
            if leaves:
                inner.append((draw(key, f"rack/{rack}", weight[region][rack]), winner(leaves)))
        if inner:
            regions.append((draw(key, f"region/{region}", sum(weight[region].values())), winner(inner)))
    if not regions:
        raise ValueError("a tree needs a shard with a weight")
    return winner(regions)


def shard_rows(df: DataFrame, key: str, tree: Tree, grown: Tree | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null without ``grown``).

    The key alone decides the shard, so rows that repeat a key share one; a missing key is a key like others. Columns
    with these names in the input are replaced. Slots need no shard in one task: rows are cut into slices by a hash of the
    whole row, slices are counted, and only slices are ordered. Pass narrow rows, they are shuffled once.
    """
    own = df.drop("shard", "slot", "grown_shard")
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    placed = own.withColumns({"shard": place(k, tree).cast("int"),
                              "grown_shard": place(k, grown).cast("int") if grown else F.lit(None).cast("int")})
    slices = max(1, -(-df.count() // (slice_rows * len([s for r in tree.values() for k in r.values() for s in k]))))
    cut = placed.withColumn("__slice", F.pmod(F.xxhash64(*own.columns), F.lit(slices)))
    counts = store(cut.groupBy("shard", "__slice").agg(F.count("*").alias("__n")), "slices")
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ordered = cut.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__slice").orderBy(*own.columns)) - 1)
    return ordered.join(starts, ["shard", "__slice"]).select(
        *own.columns, "shard", (F.col("__before") + F.col("__at")).alias("slot"), "grown_shard")
