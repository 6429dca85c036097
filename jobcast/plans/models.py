"""Fitted models in a store: one folder for each group and variant, with their centres and buffers, in published versions."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobcast.functions.scalar import inf_to_null
from jobcast.operators.windows import nearest_center
from jobcast.sources.versions import Versions

#: Kinds of regressor and whether they learn from a balanced sample.
VARIANTS = {
    "clustering_xgb": ("gbt", False), "clustering_rf": ("rf", False),
    "resampled_xgb": ("gbt", True), "resampled_rf": ("rf", True),
    "baseline": ("global_gbt", False),
}
LISTED = ("features", "target", "variant", "folder")
BUFFERS = ("mean", "mad", "std_dev", "two_sigma", "n_under")


class StoredModels:
    """One version of a model store.

    The manifest has a row for each group and variant: the group's values, what the model was fitted on, and its folder.
    The driver holds that list and no model: ``of`` loads the models of one group when the group is scored.
    """

    def __init__(self, spark: SparkSession, root: str, version: str | None = None) -> None:
        self.versions = Versions(spark, root)
        self.version = version or self.versions.newest()
        self.manifest = self.versions.table("manifest", self.version)
        self.by = tuple(c for c in self.manifest.columns if c not in LISTED)
        rows = self.manifest.collect()  # one row for each window, cluster and variant
        self.features, self.target = tuple(rows[0]["features"]), rows[0]["target"]
        self.folders = {(tuple(r[c] for c in self.by), r["variant"]): r["folder"] for r in rows}

    @property
    def biases(self) -> DataFrame:
        """The buffers of each group and model."""
        return self.versions.table("buffers", self.version, [*self.by, "model", *BUFFERS])

    @property
    def centers(self) -> DataFrame | None:
        """The groups' centres; None where groups need none."""
        return self.versions.table("centers", self.version) if "centers" in self.versions.parts(self.version) else None

    def groups(self) -> list[tuple]:
        return sorted({g for g, _ in self.folders}, key=str)

    def of(self, group: tuple) -> dict[str, object]:
        """The group's models by variant, read from the store."""
        return {v: load_model(f"{self.versions.folder(self.version)}/{folder}", v)
                for (g, v), folder in self.folders.items() if g == group}

    def newest_window(self):
        """The last window that has models; None if models are not per window."""
        at = self.by.index("window_start") if "window_start" in self.by else None
        return None if at is None else max(g[at] for g, _ in self.folders)


def placed_jobs(df: DataFrame, features: Sequence[str], centers: DataFrame) -> DataFrame:
    """``df`` with the cluster of the nearest centre among those of its window (or of all, if centres have no window).

    Jobs with a gap in a feature have no cluster.
    """
    own = [c for c in centers.columns if c not in ("cluster", "center")]
    return nearest_center(inf_to_null(df), list(features), centers, own)


def load_model(path: str, variant: str):
    return (RandomForestRegressionModel if VARIANTS[variant][0] == "rf" else GBTRegressionModel).load(path)


class ModelWriter:
    """Saves the models of a version as they are fitted, and publishes them with their buffers and centres."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)
        self.version = self.versions.begin()
        self.saved: list[tuple] = []

    def save(self, number: int, group: tuple, variant: str, model) -> None:
        """Write one model; the caller drops it, so that the driver holds the models being fitted only."""
        folder = f"models/{number}"
        model.write().save(f"{self.versions.folder(self.version)}/{folder}")
        self.saved.append((*group, variant, folder))

    def seal(self, rows: DataFrame, by: Sequence[str], features: Sequence[str], target: str,
             centers: DataFrame | None = None) -> StoredModels:
        """Write manifest and centres: the version can be read by its name, but is not published yet."""
        if not self.saved:
            raise ValueError("no group has enough rows for a model")
        kinds = StructType([rows.schema[c] for c in by]).add("variant", "string").add("folder", "string")
        listed = self.spark.createDataFrame(sorted(self.saved, key=str), kinds).select(
            *by, F.array(*[F.lit(f) for f in features]).alias("features"), F.lit(target).alias("target"), "variant", "folder")
        folder = self.versions.folder(self.version)
        listed.coalesce(1).write.parquet(folder + "/manifest")
        if centers is not None:
            centers.write.parquet(folder + "/centers")
        return StoredModels(self.spark, self.versions.root, self.version)

    def publish(self, biases: DataFrame) -> None:
        biases.write.parquet(self.versions.folder(self.version) + "/buffers")
        self.versions.publish(self.version)


def fit_all(writer: ModelWriter, wanted: Sequence[tuple], fit, threads: int) -> None:
    """Fit and save ``wanted`` (group, variant) pairs, ``threads`` side by side; at most so many models are held at once."""
    def one(item: tuple[int, tuple]) -> None:
        number, (group, variant) = item
        model = fit(group, variant)
        if model is not None:
            writer.save(number, group, variant, model)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, enumerate(wanted)))
