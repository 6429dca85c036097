"""The result store keeps experiments apart; splits, codes and draws with odd keys."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from jobcast import FUGAKU, balanced_resample, evaluate_results, label_encode, split_exact, split_hash
from jobcast.plans.evaluate import add_to_report, kept_report
from jobcast.plans.experiment import as_results, kept_results
from jobcast.session import fresh_path
from jobcast.sources.predictions import SCHEMA, clean_predictions, scan_predictions, sink_predictions
from jobcast.sources.versions import Versions


def preds(spark, windows, shift=0.0):
    rows = [(f"{i}.batch", float(10 + i), 8.0 + i + shift, w, "baseline", b) for i in range(5) for w in windows for b in ("none", "mean")]
    return spark.createDataFrame(rows, "jid string, act double, pred double, window_start string, model string, bias string").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


def test_results_of_one_run_only(spark, tmp_path):
    root = str(tmp_path / "results")
    one = FUGAKU.with_(key="jid", name="one", biases=("none", "mean"))
    two, other = one.with_(name="two"), one.with_(target="other")
    days = ["2024-01-01", "2024-01-04"]
    assert kept_results(preds(spark, days), one, root, ["baseline"]).count() == 20
    assert kept_results(preds(spark, days, 9), two, root, ["baseline"]).count() == 20
    assert kept_results(preds(spark, days), other, root, ["baseline"]).count() == 20
    again = kept_results(preds(spark, days[:1]), one, root, ["baseline"])
    assert again.count() == 10 and {r.job_id for r in again.collect()} == {f"{i}.batch" for i in range(5)}
    kept = scan_predictions(spark, root, schema=again.schema)
    assert {tuple(r) for r in kept.groupBy("trace", "target").count().collect()} == {
        ("one", one.target, 10), ("two", one.target, 20), ("one", "other", 20)}
    assert scan_predictions(spark, root, traces=["two"], targets=[one.target], window_sizes=[one.window_days], schema=again.schema).count() == 20
    report = {(r.trace, r.target, r.bias): r.n_jobs for r in evaluate_results(kept).collect()}
    assert report[("one", one.target, "none")] == 5 and report[("two", one.target, "none")] == 10


def test_a_run_that_stops_leaves_the_store_as_it_was(spark, monkeypatch):
    root = fresh_path(spark, "results")
    one = FUGAKU.with_(key="jid", name="one", biases=("none", "mean"))
    first = kept_results(preds(spark, ["2024-01-01", "2024-01-04"]), one, root, ["baseline"])
    before = sorted(map(tuple, first.collect()))
    with monkeypatch.context() as m:  # the run's rows and manifest are written, its publication is not
        m.setattr(Versions, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept_results(preds(spark, ["2024-01-01"], 5), one, root, ["baseline"])
    assert sorted(map(tuple, scan_predictions(spark, root, schema=first.schema).collect())) == before
    assert sorted(map(tuple, first.collect())) == before  # a reader that had begun
    again = kept_results(preds(spark, ["2024-01-01"], 5), one, root, ["baseline"])
    assert again.count() == 10 and sorted(map(tuple, first.collect())) == before  # until it is cleaned, the old run stays readable
    assert len(clean_predictions(spark, root)) == 2 and scan_predictions(spark, root, schema=first.schema).count() == 10


def test_runs_replace_each_other_by_partition(spark):
    """A run over one window replaces that window of an older run; the older run's other partitions stay."""
    root = fresh_path(spark, "results")
    spec = FUGAKU.with_(key="jid", name="one", biases=("none", "mean"))
    for windows, shift in ((["2024-01-01", "2024-01-04", "2024-01-07"], 0.0), (["2024-01-04"], 100.0)):
        sink_predictions(as_results(preds(spark, windows, shift), spec), root)
    found = scan_predictions(spark, root, schema=SCHEMA.replace("job_id bigint", "job_id string"))
    got = {str(r.window_start)[:10]: (r.n, r.top) for r in found.groupBy("window_start").agg(F.count("*").alias("n"), F.max("pred").alias("top")).collect()}
    assert got == {"2024-01-01": (10, 12.0), "2024-01-04": (10, 112.0), "2024-01-07": (10, 12.0)}
    assert scan_predictions(spark, root, windows=["2024-01-04"], schema=found.schema).count() == 10
    assert scan_predictions(spark, root, models=["other"], schema=found.schema).count() == 0


def test_report_grows_with_its_windows(spark):
    root = fresh_path(spark, "report")
    with pytest.raises(ValueError):
        kept_report(spark, root)
    rows = preds(spark, ["2024-01-01", "2024-01-04"]).selectExpr("*", "3 as window_size", "act * 2 as req").union(
        preds(spark, ["2024-01-07"], 6.0).selectExpr("*", "3 as window_size", "act * 2 as req"))
    parts = [rows.where("window_start < '2024-01-04'"), rows.where("window_start >= '2024-01-04' and jid < '3'"), rows.where("window_start >= '2024-01-04' and jid >= '3'")]
    for n, part in enumerate(parts):
        add_to_report(part, root)
        whole = evaluate_results(reduce(lambda a, b: a.union(b), parts[: n + 1])).orderBy("bias").collect()
        for got, want in zip(kept_report(spark, root).orderBy("bias").collect(), whole, strict=True):
            assert all(a == b if isinstance(b, str) else a == pytest.approx(b, rel=1e-9, abs=1e-9) for a, b in zip(got, want, strict=True))
    add_to_report(rows, root, ceil=True)
    with pytest.raises(ValueError, match="ceil"):
        kept_report(spark, root)


def test_missing_keys_and_values(spark):
    df = spark.createDataFrame([(i if i % 3 else None, float("nan") if i % 4 == 0 else None if i % 4 == 1 else float(i)) for i in range(30)], "k long, v double")
    assert split_hash(df, "k", 0.2, 1).where("is_test is null").count() == 0
    with pytest.raises(Exception, match="needs a k in every row"):
        split_exact(df, "k", [], 0.2, 1).collect()
    codes = label_encode(df, ["v"]).groupBy("v").count().collect()
    assert max(r["count"] for r in codes) == 16


def test_draws_of_thin_bins_are_salted(spark, monkeypatch):
    from jobcast.operators import sampling

    rows = spark.createDataFrame([(i, float(i % 50)) for i in range(2000)] + [(9999, 1000.0)], "i long, v double")
    plain = balanced_resample(rows, "v", [], "i").select("i", "draw").collect()
    monkeypatch.setattr(sampling, "DRAWS_PER_KEY", 10)
    salted = balanced_resample(rows, "v", [], "i")
    assert sorted(salted.select("i", "draw").collect()) == sorted(plain)
    assert sum(r.i == 9999 for r in plain) == 2000
