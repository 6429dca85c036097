import random

import pytest
from pyspark.sql import functions as F

from jobcast.operators import encode as E
from jobcast.operators.scaling import text_bytes


def codes(df, col, key="i"):
    return {r[key]: r[col] for r in df.collect()}


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_label_encode_native_and_text_order(spark, max_rows):
    df = spark.createDataFrame([(0, 10, "b", 2.5), (1, 2, None, None), (2, 10, "a", -1.0), (3, None, "b", 2.5)],
                               "i int, n long, s string, x double")
    native = E.label_encode(df, ["n", "s", "x"], max_rows=max_rows)
    assert codes(native, "n") == {0: 1, 1: 0, 2: 1, 3: 2}
    assert codes(native, "s") == {0: 1, 1: 2, 2: 0, 3: 1}
    assert codes(native, "x") == {0: 1, 1: 2, 2: 0, 3: 1}
    text = E.label_encode(df, ["n", "s"], as_string=True, max_rows=max_rows)
    assert codes(text, "n") == {0: 0, 1: 1, 2: 0, 3: 2}  # "10" < "2" < "nan"
    assert codes(text, "s") == {0: 1, 1: 2, 2: 0, 3: 1}


@pytest.mark.parametrize("max_rows", [100_000, 10])
def test_label_encode_with_a_hot_value(spark, max_rows):
    """Half of all rows share a value; the large dictionary takes the shuffle path."""
    rng = random.Random(5)
    values = ["hot" if i % 2 else f"v{rng.randrange(3000):05d}" for i in range(6000)] + [None] * 50
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(8)
    order = {v: n for n, v in enumerate(sorted({v for v in values if v is not None}))}
    got = codes(E.label_encode(df, ["s"], max_rows=max_rows), "s")
    assert got == {i: order.get(v, len(order)) for i, v in enumerate(values)}


def test_label_encode_of_empty_and_all_missing(spark):
    df = spark.createDataFrame([(1, None)], "i int, s string")
    assert codes(E.label_encode(df, ["s"]), "s") == {1: 0}
    assert E.label_encode(df.where("i > 1"), ["s"]).count() == 0


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_first_seen_id(spark, max_rows):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, "c"), (5, None)], "i int, u string")
    got = {r["i"]: r["u_id"] for r in E.first_seen_id(df, "u", ["i"], max_rows=max_rows).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: -1}


def test_sequential_number_with_one_frequent_time(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 7).when(
        F.col("id") % 101 == 1, None).otherwise(F.col("id") % 50).alias("t")).repartition(6)
    got = {r["i"]: r["job_number"] for r in E.sequential_job_number(df, ["t", "i"]).collect()}
    rows = sorted(((r["t"] is None, r["t"] or 0, r["i"]) for r in df.collect()))
    assert got == {i: n + 1 for n, (_, _, i) in enumerate(rows)}


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "i int, t int")
    assert [r["i"] for r in E.sort_trace(df, ["t", "i"]).collect()] == [3, 2, 1]


def test_sample_is_stable_under_repartition(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    one = [r["i"] for r in E.random_sample_n(df, "i", 50, 3).collect()]
    two = [r["i"] for r in E.random_sample_n(df.repartition(13), "i", 50, 3).collect()]
    assert one == two == sorted(one) and len(set(one)) == 50


def test_curve_choices(spark):
    rows = [("bend", k, w, s) for k, w, s in zip(range(2, 8), [100, 60, 50, 38, 30, 25], [.2, .5, .5, .1, .1, .1])]
    rows += [("convex", k, w, s) for k, w, s in zip(range(2, 8), [100, 60, 40, 30, 25, 23], [.9, .5, .5, .1, .1, .1])]
    df = spark.createDataFrame([(c, k, float(w), s) for c, k, w, s in rows],
                               "window_start string, k int, wcss double, silhouette double")
    # differences -40 -10 -12 -8 -5, second 30 -2 4 3: first negative at place 1
    assert codes(E.elbow_k(df), "elbow_k", "window_start") == {"bend": 3, "convex": 2}
    assert codes(E.silhouette_k(df), "silhouette_k", "window_start") == {"bend": 3, "convex": 2}


def test_broadcast_needs_few_rows_and_little_text(spark, monkeypatch):
    from jobcast.operators import scaling

    df = spark.range(100).select(F.repeat(F.lit("x"), 50).alias("s"))
    assert scaling.fits_broadcast(df, 100) and not scaling.fits_broadcast(df, 99)
    monkeypatch.setattr(scaling, "BROADCAST_BYTES", 4000)
    assert not scaling.fits_broadcast(df, 100)


def test_nested_columns_count_as_bytes(spark):
    """An array of many numbers does not pass a size check as if it were nothing."""
    wide = spark.range(10).selectExpr("id", "sequence(1, 1000) as a", "named_struct('x', repeat('y', 500)) as s", "cast(repeat('z', 7) as binary) as b")
    assert wide.agg(text_bytes(wide)).first()[0] > 10 * (3000 + 500 + 7)
    assert spark.range(3).agg(text_bytes(spark.range(3))).first()[0] == 0
