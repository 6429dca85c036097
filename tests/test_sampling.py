import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobcast.operators import sampling as R
from jobcast.operators.scaling import rank_in_groups
from jobcast.operators.encode import split_hash32


def hot_groups(spark, n=4000):
    """One group with most rows, one with a NULL key, some small ones."""
    return spark.range(n).select(
        F.col("id").alias("i"), F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 8, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
        F.when(F.col("id") % 200 == 5, F.lit(1000.0)).otherwise((F.col("id") * 37 % 101).cast("double")).alias("y"))


def test_exact_split_sizes(spark):
    df = hot_groups(spark)
    rows = R.split_exact(df, "i", ["g"], 0.2, 33).groupBy("g").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert rows and all(r["t"] == math.ceil(0.2 * r["n"]) for r in rows)
    assert R.split_exact(df, "i", [], 0.4, 42).where("is_test").count() == 1600


def test_ranks_are_dense_and_follow_the_hash(spark):
    df = hot_groups(spark)
    rows = rank_in_groups(df.withColumn("h", split_hash32("i", 1)), ["g"], F.col("h"), ["i"], "r", "n").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["g"]].append(r)
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r["h"], r["i"]))
        assert [r["r"] for r in ordered] == list(range(1, len(ordered) + 1))
        assert {r["n"] for r in members} == {len(members)}


def test_hash_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "i")
    one = {r["i"] for r in R.split_hash(df, "i", 0.2, 33).where("is_test").collect()}
    two = {r["i"] for r in R.split_hash(df.repartition(11), "i", 0.2, 33).where("is_test").collect()}
    assert one == two and 300 < len(one) < 500


def test_bins_match_numpy(spark):
    values = [0.0, 1.0, 2.5, 3.7, 9.99, 10.0, 5.0, 7.2]
    df = spark.createDataFrame([(v, "a") for v in values] + [(4.0, "same"), (4.0, "same")], "y double, g string")
    got = sorted((r["y"], r["bin"]) for r in R.equal_width_bins(df, "y", ["g"]).where("g = 'a'").collect())
    want = np.digitize(values, np.linspace(0, 10, 11)) - 1
    assert got == sorted(zip(values, want.tolist()))
    assert {r["bin"] for r in R.equal_width_bins(df, "y", ["g"]).where("g = 'same'").collect()} == {10}


@pytest.mark.parametrize("by", [["g"], []])
def test_balanced_bins_reach_the_largest(spark, by):
    df = hot_groups(spark)
    drawn = R.balanced_resample(df, "y", by, "i").collect()
    binned = {r["i"]: r for r in R.equal_width_bins(df, "y", by).collect()}
    size = Counter((tuple(r[c] for c in by), r["bin"]) for r in binned.values())
    got = Counter((tuple(r[c] for c in by), r["bin"]) for r in drawn)
    for (group, b), n in got.items():
        assert n == max(v for (g, _), v in size.items() if g == group)
    assert set(got) == set(size)
    assert all(binned[r["i"]]["bin"] == r["bin"] and binned[r["i"]]["g"] == r["g"] for r in drawn)
    draws = Counter((tuple(r[c] for c in by), r["bin"], r["draw"]) for r in drawn)
    assert max(draws.values()) == 1


def test_large_draws_are_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    df = hot_groups(spark, 500)
    whole = R.balanced_resample(df, "y", ["g"], "i").select("i", "draw", "bin").collect()
    monkeypatch.undo()
    assert sorted(whole) == sorted(R.balanced_resample(df, "y", ["g"], "i").select("i", "draw", "bin").collect())


def test_weights_balance_the_bins(spark):
    rows = R.balance_weights(hot_groups(spark), "y", ["g"]).groupBy("g", "bin").agg(F.sum("weight").alias("w")).collect()
    per_group = defaultdict(set)
    for r in rows:
        per_group[r["g"]].add(round(r["w"], 6))
    assert all(len(v) == 1 for v in per_group.values())


def below(plan, node):
    """The lines of a printed plan below each line that names ``node``."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if node in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                yield lines[j]


def test_draws_are_not_gathered_for_a_broadcast(spark):
    """They come from a few sizes, whatever their number: Spark takes the exploded side for as small as these."""
    drawn = R.balanced_resample(hot_groups(spark), "y", ["g"], "i")
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    assert not [line for line in below(plan, "BroadcastExchange") if "Generate" in line]


def test_rows_drawn_under_salts_are_those_of_the_places(spark, monkeypatch):
    df = hot_groups(spark, 600)
    whole = R.balanced_resample(df, "y", ["g"], "i").select("i", "g", "bin", "draw").collect()
    monkeypatch.setattr(R, "DRAWS_PER_KEY", 3)
    assert sorted(map(str, whole)) == sorted(map(str, R.balanced_resample(df, "y", ["g"], "i").select("i", "g", "bin", "draw").collect()))


def test_chunks_of_draws_are_dealt_over_tasks(spark, monkeypatch):
    """Chunks are few and small, so adaptive execution would give all of them, and so all draws, to one task."""
    monkeypatch.setattr(R, "CHUNK", 7)
    drawn = R.balanced_resample(hot_groups(spark), "y", ["g"], "i")
    drawn.collect()
    lines = drawn._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(__chunk" in line]
    assert dealt and not any("AQEShuffleRead" in line for i in dealt for line in lines[i - 3:i])
