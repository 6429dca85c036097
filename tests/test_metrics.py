import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobcast.operators import metrics as M
from jobcast.operators import quantiles
from jobcast.operators.quantiles import exact_quantile

FRAME = "g string, pred double, act double, req double"


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.mark.parametrize(("p", "rest"), [(0.5, 10_000), (0.25, 100), (0.0, 1), (1.0, 1), (0.9, 3)])
def test_exact_quantile(spark, p, rest):
    rng = np.random.default_rng(1)
    groups = {"one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 50, None: [1.0, 5.0, 2.0],
              "big": (rng.lognormal(size=30_001) * 100).tolist(), "ties": rng.integers(0, 3, 30_000).astype(float).tolist()}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("two", None)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", ["g"], p, rest=rest).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    whole = only(exact_quantile(df.where("g = 'big'"), "v", [], p, rest=rest))
    assert whole["quantile"] == pytest.approx(np.quantile(groups["big"], p), rel=1e-12)


def test_no_task_orders_more_than_the_rest(spark, monkeypatch):
    """The values kept for the last ordering are few, however large the group; rounds narrow it to them."""
    kept, rounds = [], []
    store, narrowed = quantiles.store, quantiles.narrowed
    monkeypatch.setattr(quantiles, "store", lambda df, name: kept.append((name, out := store(df, name))) or out)
    monkeypatch.setattr(quantiles, "narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    df = spark.range(50_000).selectExpr("id % 2 as g", "if(id % 10 < 3, 5.0D, double(hash(id))) as v")
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", ["g"], 0.8, rest=20).collect()}
    rows = df.collect()
    assert got == {g: np.quantile([r.v for r in rows if r.g == g], 0.8) for g in (0, 1)} and len(rounds) >= 2
    sizes = [n for name, out in kept if name == "quantile-values" for (n,) in out.selectExpr("size(values)").collect()]
    assert len(sizes) <= 2 and all(n <= 20 for n in sizes)


def test_bias_of_groups(spark):
    shortfalls = [1.0, 2.0, 4.0, 10.0]
    rows = [("a", 0.0, s, 0.0) for s in shortfalls] + [("a", 5.0, 1.0, 0.0), ("none", 2.0, 1.0, 0.0), ("one", 1.0, 3.0, 0.0)]
    got = {r["g"]: r for r in M.underpred_bias(spark.createDataFrame(rows, FRAME), ["g"]).collect()}
    a = got["a"]
    assert (a["mean"], a["n_under"]) == (4.25, 4)
    assert a["mad"] == np.median(np.abs(np.array(shortfalls) - np.median(shortfalls)))
    assert a["std_dev"] == pytest.approx(np.std(shortfalls)) and a["two_sigma"] == pytest.approx(2 * np.std(shortfalls))
    assert got["none"]["n_under"] == 0 and got["none"]["mean"] is None and got["none"]["mad"] is None
    assert got["one"]["std_dev"] == 0.0 and got["one"]["mad"] == 0.0


def test_bias_without_groups(spark):
    got = only(M.underpred_bias(spark.createDataFrame([("a", 0.0, s, 0.0) for s in (1.0, 2.0, 4.0)], FRAME), []))
    assert got["mad"] == 1.0 and got["n_under"] == 3


def test_apply_bias(spark):
    preds = spark.createDataFrame([("a", 10.0, 1.0, 1.0), ("b", 20.0, 1.0, 1.0), ("c", 30.0, 1.0, 1.0)], FRAME)
    biases = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 6.0, 5), ("b", None, None, None, None, 0)],
                                   "g string, mean double, mad double, std_dev double, two_sigma double, n_under long")
    out = M.apply_bias(preds, biases, M.BIAS_TYPES, ["g"])
    got = {(r["g"], r["bias"]): r["pred"] for r in out.collect()}
    assert [got["a", b] for b in M.BIAS_TYPES] == [10.0, 11.0, 12.0, 13.0, 16.0]
    assert {got["b", b] for b in M.BIAS_TYPES} == {20.0} and got["c", "mean"] == 30.0
    with pytest.raises(ValueError, match="unknown bias"):
        M.apply_bias(preds, biases, ["sigma"], ["g"])


def test_window_metric_edges(spark):
    rows = [("none", 2.0, 1.0, 1.0), ("none", 1.0, 1.0, 1.0), ("one", 1.0, 3601.0, 1.0), ("one", 1.0, 1.0, 1.0)]
    got = {r["g"]: r for r in M.window_metrics(spark.createDataFrame(rows, FRAME), ["g"]).collect()}
    assert (got["none"]["ur"], got["none"]["ur_total_hours"], got["none"]["ur_mean_hours"]) == (0.0, 0.0, None)
    assert (got["one"]["ur"], got["one"]["ur_total_hours"], got["one"]["ur_std_hours"]) == (50.0, 1.0, None)


def test_pooled_rates_round_up_first(spark):
    df = spark.createDataFrame([("a", 9.5, 10.0, 0.0), ("a", 8.5, 10.0, 0.0)], FRAME)
    assert only(M.pooled_success_rate(df, ceil=True, by=["g"]))["success_rate"] == 50.0
    assert only(M.pooled_success_rate(df, by=["g"]))["success_rate"] == 0.0


def test_r2_of_constant_actuals(spark):
    assert only(M.r2_score(spark.createDataFrame([("a", 1.0, 2.0, 0.0), ("a", 2.0, 2.0, 0.0)], FRAME), ["g"]))["r2"] is None


def test_histogram_edges(spark):
    minutes = [1e-3, 1e4, 1e4 + 1, 0.0, 9e-4, 1.0]
    rows = [("a", 100.0 + 60 * m, 100.0, 0.0) for m in minutes]
    df = spark.createDataFrame(rows, FRAME)
    got = {r["error_bin"]: r["n_jobs"] for r in M.error_histogram(df, ["g"]).collect()}
    want, _ = np.histogram([abs(p - a) / 60 for _, p, a, _ in rows], bins=np.logspace(-3, 4, 50))
    assert sum(got.values()) == want.sum() and got[49] == 1 and got[22] == 1
    at_top = spark.createDataFrame([("a", 60e4 + 60.0, 60.0, 0.0)], FRAME)
    assert [r["error_bin"] for r in M.error_histogram(at_top, ["g"]).collect()] == [49]


def test_ranges_are_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 3600, 3601, 172800, 172801)], "act double")
    got = [r["r"] for r in df.select(M.act_range(F.col("act"), M.ACT_BOUNDS).alias("r")).collect()]
    assert got == [None, 0, 0, 1, 4, None]


def test_empty_request_bins_are_kept(spark):
    df = spark.createDataFrame([(10.0, 1.0), (10.5, 3.0), (0.0, 9.0), (30000.0, 9.0)],
                               "wallclock_req_min double, wait_hours double")
    got = {r["label"]: r["mean_wait_hours"] for r in M.wait_by_request_bin(df).collect()}
    assert len(got) == 11 and got["0-10min"] == 1.0 and got["10min-1hr"] == 3.0 and got["8days-16days"] is None


def test_box_statistics(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("m", v) for v in values], "model string, ur double")
    got = only(M.boxplot_stats(df, ["ur"], ["model"]))
    assert (got["q1"], got["median"], got["q3"], got["whisker_low"], got["whisker_high"], got["n_outliers"]) == (
        2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_density_against_numpy_for_many_and_few_rows(spark):
    rng = np.random.default_rng(2)
    for n in (5, 3000):
        values = rng.lognormal(sigma=2.0, size=n)
        df = spark.createDataFrame([("m", float(v)) for v in values] + [("m", 0.0), ("single", 2.0)], "g string, f double")
        got = M.kde_density(df, "f", ["g"]).orderBy("grid_id").collect()
        x = np.log10(values)
        width = x.std(ddof=1) * n ** -0.2
        grid = np.linspace(x.min() - 3 * width, x.max() + 3 * width, 200)
        want = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(axis=1) / (n * width * math.sqrt(2 * math.pi))
        assert [r["g"] for r in got] == ["m"] * 200
        assert np.allclose([r["log10_x"] for r in got], grid) and np.allclose([r["density"] for r in got], want, atol=1e-12)


def test_scaling_and_imputation(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", inf, 5.0), ("b", None, 5.0), ("b", 7.0, 5.0)],
                               "g string, x double, c double")
    assert sorted(r["x"] for r in M.mean_impute(df, ["x"], ["g"]).collect()) == [1.0, 2.0, 3.0, 7.0, 7.0]
    finite = df.where("x < 100 or x is null")
    got = M.minmax_scale(finite, ["x", "c"]).collect()
    assert sorted((r["x"] for r in got), key=lambda v: (v is None, v)) == [0.0, pytest.approx(1 / 3), 1.0, None]
    assert {r["c"] for r in got} == {0.0}
