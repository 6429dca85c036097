"""Regressors per group of jobs, the buffers learned from their shortfalls, and scoring."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from jobcast.functions.filters import drop_incomplete
from jobcast.functions.scalar import inf_to_null
from jobcast.operators.metrics import apply_bias, underpred_bias
from jobcast.operators.sampling import balance_weights, balanced_resample, split_hash
from jobcast.plans.ledger import Ledger
from jobcast.plans.models import VARIANTS, ModelWriter, StoredModels, fit_all, placed_jobs
from jobcast.session import fresh_path, store

GROUP = ("window_start", "cluster")
VALIDATION_FRACTION = 0.4
VALIDATION_SEED = 42
FIT_THREADS = 8
# Published settings of the three regressors.
REFERENCE = {
    "gbt": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "maxBins": 256},
    "rf": {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "all"},
    "global_gbt": {
        "maxIter": 168, "maxDepth": 7, "stepSize": 0.3968571956999504, "maxBins": 256,
        "subsamplingRate": 0.747747407403972, "featureSubsetStrategy": "0.6280085182287491"},
}
FAST = {
    "gbt": {"maxIter": 4, "maxDepth": 4, "stepSize": 0.3},
    "rf": {"numTrees": 6, "maxDepth": 6, "featureSubsetStrategy": "all"},
    "global_gbt": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3968571956999504,
                   "subsamplingRate": 0.747747407403972, "featureSubsetStrategy": "0.6280085182287491"},
}
# A single tree without sampling predicts the mean of its leaf, which SQL can recompute.
ONE_TREE = {
    "gbt": {"maxIter": 1, "maxDepth": 5},
    "rf": {"numTrees": 1, "maxDepth": 5, "featureSubsetStrategy": "all", "bootstrap": False},
    "global_gbt": {"maxIter": 1, "maxDepth": 5},
}
PRESETS = {"reference": REFERENCE, "fast": FAST, "one_tree": ONE_TREE}


def on_log_scale(variant: str) -> bool:
    return VARIANTS[variant][0] != "rf"


def clean_rows(df: DataFrame, features: Sequence[str], target: str, key: str,
               complete_on: Sequence[str] | None = None) -> DataFrame:
    """Rows without a gap in any column (or in ``complete_on``); features as doubles, unless one is the key."""
    whole = drop_incomplete(inf_to_null(df), complete_on)
    return whole.withColumns({c: F.col(c).cast("double") for c in {*features, target} - {key}})


def prepare_rows(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = GROUP,
                 key: str = "job_id", request: str | None = None, keep: Sequence[str] = (),
                 complete_on: Sequence[str] | None = None) -> DataFrame:
    """Clean rows with their validation flag, stored by group so that a fit reads its own group only."""
    rows = clean_rows(df, features, target, key, complete_on)
    if request:
        rows = rows.withColumn("req", F.col(request).cast("double"))
    extra = ["req"] if request else []
    rows = rows.select(*dict.fromkeys([*by, key, *features, target, *extra, *keep]))
    flagged = split_hash(rows, key, VALIDATION_FRACTION, VALIDATION_SEED, "is_val")
    return store(flagged, "model-rows", tuple(by))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__vec").transform(df)


def fit_one(rows: DataFrame, features: Sequence[str], target: str, variant: str, preset: str,
            weight: str | None = None):
    kind = VARIANTS[variant][0]
    settings = dict(PRESETS[preset][kind], featuresCol="__vec", labelCol="__label",
                    predictionCol="__p_" + variant, seed=VALIDATION_SEED)
    if weight is not None:
        settings["weightCol"] = weight
    if on_log_scale(variant):
        rows = rows.where(F.col(target) > 0).withColumn("__label", F.ln(target))
    else:
        rows = rows.withColumn("__label", F.col(target))
    learner = RandomForestRegressor if kind == "rf" else GBTRegressor
    kept = ["__vec", "__label"] + ([weight] if weight else [])
    return learner(**settings).fit(assembled(rows, features).select(*kept))


def score(rows: DataFrame, models: dict[str, object], features: Sequence[str], target: str,
          keep: Sequence[str]) -> DataFrame:
    """One row per job and model, from a single pass over ``rows``."""
    scored = assembled(rows, features)
    for model in models.values():
        scored = model.transform(scored)
    choices = F.array(*[F.struct(
        F.lit(v).alias("model"),
        (F.exp("__p_" + v) if on_log_scale(v) else F.col("__p_" + v)).alias("pred"),
    ) for v in models])
    return scored.select(*keep, F.col(target).alias("act"), F.inline(choices))


def of_group(df: DataFrame, by: Sequence[str], group: tuple) -> DataFrame:
    """A group's rows; a partition filter where ``df`` is stored by group."""
    for c, v in zip(by, group):
        kind = df.schema[c].dataType
        value = F.lit(str(v)).cast(kind) if isinstance(kind, TimestampNTZType) else F.lit(v).cast(kind)
        df = df.where(F.col(c) == value)
    return df


def written_by_group(spark: SparkSession, groups: Sequence, rows_of, schema, name: str) -> DataFrame:
    """Each group's rows, written by Spark jobs of which a few run side by side, as one table."""
    if not groups:
        raise ValueError("no group has enough rows for a model")
    root = fresh_path(spark, name)
    with ThreadPoolExecutor(FIT_THREADS) as pool:
        list(pool.map(lambda item: rows_of(item[1]).write.parquet(f"{root}/part={item[0]}"), enumerate(groups)))
    return spark.read.schema(schema).parquet(*[f"{root}/part={n}" for n in range(len(groups))])


def scored_schema(df: DataFrame, keep: Sequence[str]) -> StructType:
    return (StructType([df.schema[c] for c in keep]).add("act", "double").add("model", "string")
            .add("pred", "double"))


def score_groups(df: DataFrame, trained: StoredModels, keep: Sequence[str]) -> DataFrame:
    """Score each group with its own models, which are read from the store for it and dropped with it."""
    def rows_of(group: tuple) -> DataFrame:
        return score(of_group(df, trained.by, group), trained.of(group), trained.features, trained.target, keep)

    return written_by_group(df.sparkSession, trained.groups(), rows_of, scored_schema(df, keep), "scored")


@dataclass
class TrainingRows:
    """The fitting parts of all groups, plain and balanced, and the groups that have enough rows."""

    plain: DataFrame
    balanced: DataFrame | None
    weight: str | None
    groups: dict[tuple, int]
    by: list[str]

    def fit(self, group: tuple, variant: str, features: Sequence[str], target: str, preset: str):
        """The group's model, or None if the logarithm leaves no rows."""
        if on_log_scale(variant) and self.groups[group] == 0:
            return None
        resampled = VARIANTS[variant][1]
        part = of_group(self.balanced if resampled else self.plain, self.by, group)
        return fit_one(part, features, target, variant, preset, self.weight if resampled else None)


def training_rows(rows: DataFrame, target: str, variants: Sequence[str], by: Sequence[str], key: str,
                  method: str, leaky: bool, min_rows: int) -> TrainingRows:
    unknown = [v for v in variants if v not in VARIANTS]
    if unknown:
        raise ValueError(f"unknown variants: {unknown}; choose from {list(VARIANTS)}")
    if method not in ("draw", "weights"):
        raise ValueError(f"method must be 'draw' or 'weights', not {method!r}")
    by = list(by)
    fitting = ~F.col("is_val")
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(fitting).alias("fit"),
        F.count_if(fitting & (F.col(target) > 0)).alias("positive")).where(
        (F.col("n") >= min_rows) & (F.col("fit") > 0))
    groups = {tuple(r[c] for c in by): r["positive"] for r in counted.collect()}  # a row per window and cluster
    plain = rows.where(fitting)
    balanced = weight = None
    if any(VARIANTS[v][1] for v in variants):
        source = rows if leaky else plain
        if method == "draw":
            balanced = store(balanced_resample(source, target, by, key), "balanced-rows", tuple(by))
        else:
            weight = "weight"
            balanced = store(balance_weights(source, target, by), "weighted-rows", tuple(by))
    return TrainingRows(plain, balanced, weight, groups, by)


def train_variants(df: DataFrame, features: Sequence[str], target: str, variants: Iterable[str],
                   preset: str = "reference", by: Sequence[str] = GROUP, key: str = "job_id",
                   method: str = "draw", leaky: bool = False, min_rows: int = 2,
                   complete_on: Sequence[str] | None = None, centers: DataFrame | None = None,
                   root: str | None = None) -> StoredModels:
    """Fit each variant on 60 % of each group and learn its buffers on the other 40 %.

    Spark ML spreads each fit over the cluster and a few fits run side by side.
    ``method`` is ``draw`` (copies) or ``weights`` for balanced variants;
    ``leaky`` lets the balanced sample draw from validation rows too.

    Models go to the store under ``root`` as they are fitted, one folder each; manifest, buffers and ``centers`` (``by`` without
    ``cluster``, ``cluster``, ``center``) follow, and the whole becomes the store's newest version at once. With centres, ``df``
    may come without ``cluster``: its jobs are placed first.
    """
    spark, variants, by, features = df.sparkSession, list(variants), list(by), list(features)
    if centers is not None and "cluster" not in df.columns:
        df = placed_jobs(df, features, centers)
    rows = prepare_rows(df, features, target, by, key, complete_on=complete_on)
    source = training_rows(rows, target, variants, by, key, method, leaky, min_rows)
    writer = ModelWriter(spark, root or fresh_path(spark, "models"))
    fit_all(writer, [(g, v) for g in source.groups for v in variants],
            lambda group, variant: source.fit(group, variant, features, target, preset), FIT_THREADS)
    trained = writer.seal(rows, by, features, target, centers)
    held_out = score_groups(rows.where("is_val"), trained, by)
    writer.publish(underpred_bias(held_out, [*by, "model"]))
    return trained


def fit_and_score(rows: DataFrame, features: Sequence[str], target: str, variants: Iterable[str], preset: str,
                  bias_types: Sequence[str], by: Sequence[str] = GROUP, key: str = "job_id",
                  method: str = "draw", min_rows: int = 2, ledger: Ledger | None = None) -> DataFrame:
    """Predictions for the test rows of ``prepare_rows`` output, from models fitted on the others.

    A group's models are dropped once its validation and test rows are scored,
    in one pass, so the driver holds the models of a few groups only. A ``ledger`` keeps the scored rows
    of each group; groups and variants that it has are not fitted again.
    """
    variants, by = list(variants), list(by)
    source = training_rows(rows.where(~F.col("is_test")), target, variants, by, key, method, False, min_rows)
    keep = [*by, key, "is_test"] + (["req"] if "req" in rows.columns else [])
    judged = rows.where(F.col("is_test") | F.col("is_val"))

    def rows_of(group: tuple, wanted: Sequence[str] = tuple(variants)) -> DataFrame:
        models = {v: source.fit(group, v, features, target, preset) for v in wanted}
        models = {v: m for v, m in models.items() if m is not None}
        return score(of_group(judged, by, group), models, features, target, keep)

    # variants whose logarithm leaves a group no rows have no model there
    fitted = {g: [v for v in variants if n > 0 or not on_log_scale(v)] for g, n in source.groups.items()}
    groups, schema = [g for g, own in fitted.items() if own], scored_schema(rows, keep)
    if ledger:
        scored = ledger.scored({g: fitted[g] for g in groups}, rows_of, schema, FIT_THREADS)
    else:
        scored = written_by_group(rows.sparkSession, groups, rows_of, schema, "scored")
    biases = underpred_bias(scored.where(~F.col("is_test")), [*by, "model"])
    return apply_bias(scored.where("is_test").drop("is_test"), biases, bias_types, [*by, "model"])


def train_cluster_gbt(df: DataFrame, features: Sequence[str], target: str, preset: str = "reference",
                      **options) -> StoredModels:
    return train_variants(df, features, target, ["clustering_xgb"], preset, **options)


def train_cluster_rf(df: DataFrame, features: Sequence[str], target: str, preset: str = "reference",
                     **options) -> StoredModels:
    return train_variants(df, features, target, ["clustering_rf"], preset, **options)


def train_resampled(df: DataFrame, features: Sequence[str], target: str, kind: str = "xgb",
                    preset: str = "reference", method: str = "draw", **options) -> StoredModels:
    return train_variants(df, features, target, ["resampled_" + kind], preset, method=method, **options)


def train_global_gbt(df: DataFrame, features: Sequence[str], target: str, preset: str = "reference",
                     by: Sequence[str] = (), **options) -> StoredModels:
    """One model for all jobs (or one per ``by``, such as the window)."""
    return train_variants(df, features, target, ["baseline"], preset, by=by, **options)


def predict_per_cluster(df: DataFrame, trained: StoredModels, bias_types: Sequence[str],
                        request: str | None = None, key: str = "job_id",
                        complete_on: Sequence[str] | None = None) -> DataFrame:
    """``(by..., job_id, model, bias, pred, act[, req])``; rows of a group without a model are left out.

    Where the store holds centres, jobs are placed by them, whether or not ``df`` has a ``cluster``: nearest centre of the
    job's window, then that cluster's models, one group at a time. A job with a gap in a feature has no place.
    """
    by = list(trained.by)
    if trained.centers is not None:
        df = placed_jobs(df.drop("cluster"), trained.features, trained.centers)
    rows = prepare_rows(df, trained.features, trained.target, by, key, request, complete_on=complete_on)
    scored = score_groups(rows, trained, [*by, key] + (["req"] if request else []))
    return apply_bias(scored, trained.biases, bias_types, [*by, "model"])


def predict_global(df: DataFrame, trained: StoredModels, bias_types: Sequence[str],
                   request: str | None = None, key: str = "job_id", **options) -> DataFrame:
    return predict_per_cluster(df, trained, bias_types, request, key, **options)
