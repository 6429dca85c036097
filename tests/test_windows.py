from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobcast.operators import windows as W
from jobcast.spec import EAGLE, FUGAKU, M100


@pytest.mark.parametrize("spec,count", [(FUGAKU, 9), (M100, 11), (EAGLE, 51)])
def test_window_counts_of_the_traces(spark, spec, count):
    windows = W.window_table(spark, spec.first_window, spec.last_window, spec.window_days, spec.window_step)
    rows = windows.orderBy("window_start").collect()
    assert len(rows) == count
    assert all((r["window_end"] - r["window_start"]).days == spec.window_days for r in rows)


def test_month_ends_and_bad_steps(spark):
    rows = [r["window_start"] for r in W.window_table(spark, "2018-11-14", "2019-02-28", 30, "1M")
            .orderBy("window_start").collect()]
    assert rows == [datetime(2018, 11, 30), datetime(2018, 12, 31), datetime(2019, 1, 31), datetime(2019, 2, 28)]
    with pytest.raises(ValueError):
        W.window_table(spark, "2018-11-14", "2019-02-28", 30, "2W")


def test_half_open_edges(spark):
    df = spark.sql("""select 1 i, timestamp_ntz'2024-01-01 00:00:00' t union all
        select 2, timestamp_ntz'2024-01-03 23:59:59.999999' union all select 3, timestamp_ntz'2024-01-04 00:00:00'
        union all select 4, timestamp_ntz'2023-12-31 23:59:59.999999' union all select 5, null""")
    tumbling = {r["i"]: r["window_start"].day for r in
                W.assign_windows_tumbling(df, "t", 3, "2024-01-01", "2024-01-04").collect()}
    assert tumbling == {1: 1, 2: 1, 3: 4}
    windows = W.window_table(spark, "2024-01-01", "2024-01-04", 3, "3D")
    sliding = {r["i"]: r["window_start"].day for r in W.assign_windows_sliding(df, windows, "t").collect()}
    assert sliding == tumbling


def test_overlapping_windows_repeat_rows(spark):
    df = spark.sql("select timestamp_ntz'2024-01-08 12:00:00' t")
    windows = W.window_table(spark, "2024-01-01", "2024-01-28", 9, "3D")
    got = sorted(r["window_start"].day for r in W.assign_windows_sliding(df, windows, "t").collect())
    assert got == [1, 4, 7]


def test_nearest_center_ties_gaps_and_table(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 1.0, "a"), (3, None, "a"), (4, 9.0, "b"), (5, float("nan"), "b")],
                               "i int, x double, g string")
    got = {r["i"]: r["cluster"] for r in W.nearest_center(df, ["x"], [[0.0], [10.0]]).collect()}
    assert got == {1: 0, 2: 0, 3: None, 4: 1, 5: None}
    centers = spark.createDataFrame([("a", 0, [0.0]), ("a", 1, [4.0]), ("b", 0, [9.0]), ("b", 1, [0.0])],
                                    "g string, cluster int, center array<double>")
    got = {r["i"]: r["cluster"] for r in W.nearest_center(df, ["x"], centers, ["g"]).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: 0, 5: None}


def test_nearest_center_against_numpy(spark):
    rng = np.random.default_rng(3)
    points, centers = rng.normal(size=(200, 3)), rng.normal(size=(5, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, a double, b double, c double")
    got = [r["cluster"] for r in W.nearest_center(df, ["a", "b", "c"], centers.tolist()).orderBy("i").collect()]
    want = np.argmin(np.linalg.norm(centers[:, None] - points, axis=2), axis=0).tolist()
    assert got == want


def test_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a", 7)], "k string, v int")
    got = {r["k"]: r["v"] for r in W.lookup_join(df, dim, "k").collect()}
    assert got == {"a": 7, "b": -1, None: -1}


def test_sliding_assignment_joins_on_the_day(spark):
    df = spark.range(10).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"))
    windows = W.window_table(spark, "2024-01-01", "2024-01-28", 9, "3D")
    plan = W.assign_windows_sliding(df, windows, "t")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
