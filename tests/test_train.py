import pytest
from pyspark.sql import functions as F

from jobcast.checks import QUERIES
from jobcast.checks.registry import SPEC, finished
from jobcast.checks.training import FEATURES, HALF_MONTHS, labelled, trace
from jobcast.operators.metrics import BIAS_TYPES
from jobcast.operators.sampling import split_hash
from jobcast.plans import train as T
from jobcast.plans.evaluate import evaluate_results
from jobcast.plans.experiment import GROUPED, experiment_grouped, grouped_jobs
from jobcast.plans.ledger import Ledger
from jobcast.sources.predictions import scan_predictions
from jobcast.session import fresh_path, store
from test_sampling import below


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return split_hash(labelled(spark, sf_dir), "job_id", 0.2, 33).cache()


def test_buffers_only_lower_the_under_prediction(rows):
    trained = T.train_variants(rows.where(~F.col("is_test")), FEATURES, "run_time",
                               ["clustering_xgb", "clustering_rf", "resampled_rf"], "fast")
    preds = T.predict_per_cluster(rows.where("is_test"), trained, BIAS_TYPES, "elpl").cache()
    assert preds.where("pred <= 0 and model = 'clustering_xgb'").count() == 0
    counted = {(r["model"], r["bias"]): r for r in preds.groupBy("model", "bias").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") < F.col("act")).alias("u")).collect()}
    n = rows.where("is_test").count()
    for model in ("clustering_xgb", "clustering_rf", "resampled_rf"):
        assert counted[model, "two_sigma"]["u"] <= counted[model, "std_dev"]["u"] <= counted[model, "none"]["u"]
        assert all(counted[model, b]["n"] == n for b in BIAS_TYPES)


def test_small_groups_have_no_model_and_no_rows(spark, rows):
    single = rows.where("cluster = 0").limit(1).withColumn("cluster", F.lit(9))
    data = rows.where(~F.col("is_test")).unionByName(single).cache()
    trained = T.train_cluster_rf(data, FEATURES, "run_time", "one_tree")
    assert 9 not in {g[1] for g in trained.groups()}
    preds = T.predict_per_cluster(data, trained, ["none"])
    assert preds.where("cluster = 9").count() == 0 and "req" not in preds.columns


def test_weights_instead_of_copies(rows):
    data = rows.where(~F.col("is_test"))
    for method in ("weights", "draw"):
        trained = T.train_resampled(data, FEATURES, "run_time", "rf", "one_tree", method=method)
        assert len(trained.folders) == 4 and trained.biases.count() == 4
    with pytest.raises(ValueError):
        T.train_resampled(data, FEATURES, "run_time", "rf", "one_tree", method="copy")
    with pytest.raises(ValueError):
        T.train_variants(data, FEATURES, "run_time", ["lstm"], "one_tree")


def test_zero_targets_are_kept_for_forests_and_left_out_of_logs(spark, rows):
    zeros = rows.withColumn("run_time", F.when(F.col("job_id") % 2 == 0, 0.0).otherwise(F.col("run_time")))
    trained = T.train_variants(zeros, FEATURES, "run_time", ["clustering_xgb", "clustering_rf"], "one_tree")
    preds = T.predict_per_cluster(zeros, trained, ["none"]).groupBy("model").agg(F.avg("pred").alias("p"))
    got = {r["model"]: r["p"] for r in preds.collect()}
    assert got["clustering_rf"] < got["clustering_xgb"]


def test_reference_settings_are_accepted(spark, rows):
    settings = T.PRESETS["reference"]
    T.GBTRegressor(**settings["gbt"]), T.GBTRegressor(**settings["global_gbt"])
    T.RandomForestRegressor(**settings["rf"])


def test_incomplete_rows_help_grouping_only(spark, sf_dir):
    placed = grouped_jobs(trace(spark, sf_dir), HALF_MONTHS)
    assert placed.where("mszl is null or freq_req is null or isnan(freq_req)").count() == 0
    assert {r["cluster"] for r in placed.select("cluster").distinct().collect()} <= set(range(HALF_MONTHS.clusters))
    whole = finished(spark, sf_dir).where("mszl is not null and not isnan(freq_req) and freq_req < 1e9").count()
    assert placed.count() == whole


def test_experiments_fill_one_store(spark, sf_dir):
    root = fresh_path(spark, "test-predictions")
    spec = HALF_MONTHS.with_(biases=("none", "two_sigma"))
    first = experiment_grouped(trace(spark, sf_dir), spec, "one_tree", ["clustering_rf"], root, exact_split=True)
    n = first.count()
    experiment_grouped(trace(spark, sf_dir), spec, "one_tree", ["resampled_rf"], root, exact_split=True)
    assert scan_predictions(spark, root).count() == 2 * n
    experiment_grouped(trace(spark, sf_dir), spec, "one_tree", ["resampled_rf"], root, exact_split=True)
    both = scan_predictions(spark, root)
    assert both.count() == 2 * n  # a repeated experiment replaces its own results
    plan = scan_predictions(spark, root, models=["resampled_rf"], windows=["2024-01-01"])
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["model"] for r in plan.select("model").distinct().collect()} == {"resampled_rf"}
    report = evaluate_results(both).collect()
    assert len(report) == 4 and all(r["n_windows"] == 2 for r in report)


def test_an_experiment_that_stopped_goes_on(spark, sf_dir, monkeypatch):
    """After a stop, the groups and variants that are finished are not fitted again, and the results are those of one run."""
    spec, data = HALF_MONTHS.with_(biases=("none", "two_sigma")), trace(spark, sf_dir).cache()
    variants = ["clustering_rf", "clustering_xgb"]
    resume, fits, fit = fresh_path(spark, "ledger"), [], T.fit_one

    def stopping(*args):
        if len(fits) >= 3:
            raise RuntimeError("stopped")
        fits.append(args[3])
        return fit(*args)

    monkeypatch.setattr(T, "FIT_THREADS", 1)
    monkeypatch.setattr(T, "fit_one", stopping)
    with pytest.raises(RuntimeError):
        experiment_grouped(data, spec, "one_tree", variants, resume=resume)
    done = len(Ledger(spark, resume, (spec.with_(biases=()), "one_tree", False)).entries())
    again = []
    monkeypatch.setattr(T, "fit_one", lambda *args: again.append(args[3]) or fit(*args))
    got = experiment_grouped(data, spec, "one_tree", variants, resume=resume)
    assert 0 < done < 8 and len(again) == 8 - done  # two windows, two clusters, two variants
    count = len(again)
    twice = experiment_grouped(data, spec, "one_tree", [*variants, "resampled_rf"], resume=resume)
    assert len(again) == count + 4  # the new variant only
    whole = experiment_grouped(data, spec, "one_tree", variants)
    keyed = lambda df: {(r.job_id, r.window_start, r.model, r.bias): (r.cluster, r.pred) for r in df.collect()}
    assert keyed(got) == keyed(whole) == keyed(twice.where("model <> 'resampled_rf'"))


def test_spec_defaults_name_known_biases():
    assert set(SPEC.biases) == set(BIAS_TYPES)


def test_grouped_boosting_is_checked_with_published_settings(spark, sf_dir, monkeypatch):
    seen, fit = [], T.train_cluster_gbt

    def spy(df, features, target, preset):
        seen.append(preset)
        return fit(df, features, target, "one_tree")

    monkeypatch.setattr(T, "train_cluster_gbt", spy)
    QUERIES["train_cluster_gbt"](spark, sf_dir)
    assert seen == ["reference"]


def test_balanced_rows_are_written_without_a_broadcast_of_draws(spark, sf_dir, monkeypatch):
    """The driver gathers what is broadcast: for an experiment's largest bins that was several GB of draws."""
    frames = {}
    monkeypatch.setattr(T, "store", lambda df, name, by=(): frames.update({name: df}) or store(df, name, by))
    jobs = grouped_jobs(trace(spark, sf_dir), HALF_MONTHS)
    rows = T.prepare_rows(jobs, HALF_MONTHS.features, "run_time", T.GROUP, "job_id", None, ["is_test"])
    T.training_rows(rows.where(~F.col("is_test")), "run_time", GROUPED, T.GROUP, "job_id", "draw", False, 2)
    plan = frames["balanced-rows"]._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    assert not [line for line in below(plan, "BroadcastExchange") if "Generate" in line]
