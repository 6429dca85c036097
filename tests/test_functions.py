from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobcast.functions import filters as P
from jobcast.functions import labels as L
from jobcast.functions import scalar as S
from jobcast.spec import EAGLE, M100


def column(df, name):
    return [r[name] for r in df.collect()]


def test_time_limits(spark):
    df = spark.createDataFrame([("1-02:03:04",), ("2-05:30",), ("10:20:30",), ("24:00",)], "t string")
    assert column(S.time_limit_seconds(df, "t"), "time_limit_sec") == [
        86400 + 2 * 3600 + 3 * 60 + 4, 2 * 86400 + 5 * 3600 + 1800, 10 * 3600 + 20 * 60 + 30, 86400]


@pytest.mark.parametrize("text", ["UNLIMITED", "12", "1:2:3:4", "1-2-03:00", "a:b", "1-5", None])
def test_unreadable_time_limits(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert column(S.time_limit_seconds(df, "t", strict=False), "time_limit_sec") == [None]
    with pytest.raises(Exception, match="unreadable time limit"):
        S.time_limit_seconds(df, "t").collect()


def test_parse_modes(spark):
    df = spark.createDataFrame([("2024:01:02 03",), ("nope",)], "t string")
    with pytest.raises(Exception):
        S.parse_timestamps(df, ["t"], "yyyy:MM:dd HH").collect()
    assert column(S.parse_timestamps(df, ["t"], "yyyy:MM:dd HH", "coerce"), "t") == [datetime(2024, 1, 2, 3), None]
    with pytest.raises(ValueError):
        S.parse_timestamps(df, ["t"], errors="ignore")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_elapsed_seconds_keep_fractions_and_ignore_the_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The second span crosses a clock change in New York; naive values do not know it.
        df = spark.sql("""select timestamp_ntz'2024-03-09 00:00:00' a, timestamp_ntz'2024-03-09 00:00:01.25' b
            union all select timestamp_ntz'2024-03-10 00:00:00', timestamp_ntz'2024-03-11 00:00:00'
            union all select timestamp_ntz'2024-03-10 00:00:00', null""")
        assert column(S.wait_time(df, "a", "b"), "wait_time") == [1.25, 86400.0, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_strip_timezone(spark):
    df = spark.sql("select timestamp'2024-04-05 00:00:00+09:00' a, timestamp_ntz'2024-04-05 00:00:00' b")
    out = S.strip_timezone(S.strip_timezone(df, ["a"]), ["b"], "Asia/Tokyo").select(
        F.col("a").cast("string"), F.col("b").cast("string")).first()
    assert tuple(out) == ("2024-04-04 15:00:00", "2024-04-04 15:00:00")


def test_ratio_and_status(spark):
    df = spark.createDataFrame([(4.0, 2.0, "completed"), (None, 2.0, "FAILED"), (4.0, 0.0, "cancelled"),
                                (4.0, None, "other")], "n double, d double, s string")
    assert column(S.safe_ratio(df, "n", "d"), "ratio") == [2.0, 0.0, -1.0, -1.0]
    assert column(S.status_code_map(df, "s"), "status") == [1, 0, 5, -1]
    assert column(S.status_code_map(df, "s", strict_case=True), "status") == [1, 0, -1, -1]


def test_missing_and_infinite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, inf), (2, -inf), (3, nan), (4, None), (5, 2.0)], "i int, x double")
    assert column(S.inf_to_null(df), "x") == [None, None, None, None, 2.0]
    profile = P.feature_profile(df, ["i", "x"]).collect()
    assert [tuple(r) for r in profile] == [("i", 0, 0, 5), ("x", 2, 2, 1)]


def test_feature_checks(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    with pytest.raises(ValueError, match="not in the trace"):
        P.feature_profile(df, ["i", "z"])
    with pytest.raises(ValueError, match="not numeric"):
        P.feature_profile(df, ["s"])


def test_log_and_ceil(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "pred double")
    assert column(S.log_target(df, "pred"), "log_pred") == [None, None, 0.0, None]
    some = spark.createDataFrame([(1.2,), (2.0,), (-0.5,), (None,)], "pred double")
    assert column(S.ceil_prediction(some), "pred") == [2.0, 2.0, 0.0, None]


def test_success_keeps_missing_run_time(spark):
    df = spark.createDataFrame([("COMPLETED", 0.0), ("COMPLETED", None), ("COMPLETED", 5.0), ("TIMEOUT", 0.0)],
                               "state string, run_time double")
    assert column(P.filter_success(df, EAGLE), "run_time") == [None, 5.0]
    assert P.filter_failure(df, EAGLE).count() == 1
    with pytest.raises(ValueError):
        P.filter_failure(df, M100)


def test_labels(spark):
    df = spark.createDataFrame([("baseline", "two_sigma"), ("mine", "none")], "model string, bias string")
    assert column(L.model_bias_label(df), "label") == ["Single-XGB + 2σ", "mine - none"]
    ranges = spark.createDataFrame([(0, 3600), (3600, 21600), (43200, 86400), (86400, 172800)], "a int, b int")
    assert column(L.format_bounds_label(ranges, "a", "b"), "bounds_label") == [
        "(0m, 1h]", "(1h, 6h]", "(12h, 1d]", "(1d, 2d]"]
    errors = spark.createDataFrame([(60.0,), (90.0,)], "m double")
    assert column(L.format_error_label(errors, "m"), "error_label") == ["60.0 minutes", "1.5 hours"]


def test_min_group_size_counts_missing_keys_as_a_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, g string")
    assert sorted(column(P.min_group_size(df, ["g"]), "i")) == [1, 2, 4, 5]
