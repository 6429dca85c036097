"""Job grouping with k-means, its tuning curves and silhouettes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.functions.filters import check_features
from jobcast.operators.encode import elbow_k, silhouette_k
from jobcast.operators.metrics import mean_impute, minmax_scale
from jobcast.operators.windows import nearest_center, squared_distance
from jobcast.session import store

FIT_THREADS = 4
TILE_POINTS = 32_768
TILE_ROWS = 256
# Points and totals (points times clusters) of the largest share that a task holds; block of distances that it makes at once.
SHARE_POINTS, SHARE_TOTALS = 500_000, 4_000_000
BLOCK_ROWS, BLOCK_COLUMNS = 64, 1024
# Share of a curve's largest cost below which a second difference is a rounding error.
ROUNDING = 1e-9
# Rows from which it pays to merge equal ones before a curve's fits, and the column with their number.
MERGE_ROWS = 2_000_000
WEIGHT = "__weight"


def work_names(features: Sequence[str]) -> list[str]:
    return [f"__f{i}" for i in range(len(features))]


def feature_vectors(df: DataFrame, features: Sequence[str], scale: bool) -> DataFrame:
    """``df`` plus imputed (and scaled) copies of the features and their vector."""
    check_features(df, features)
    work = work_names(features)
    copied = df.withColumns({w: F.col(f).cast("double") for w, f in zip(work, features)})
    ready = mean_impute(copied, work)
    if scale:
        ready = minmax_scale(ready, work)
    return VectorAssembler(inputCols=work, outputCol="__vec").transform(ready)


def kmeans_group_jobs(df: DataFrame, features: Sequence[str], k: int, seed: int = 42,
                      scale: bool = False) -> tuple[DataFrame, KMeansModel]:
    """``df`` with its ``cluster``, and the fitted model holding the centres."""
    vectors = feature_vectors(df, features, scale)
    model = KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("__vec", *work_names(features)), model


def fitted_curve(df: DataFrame, features: Sequence[str], max_k: int, scale: bool, seed: int,
                 measure: Callable[[KMeansModel, DataFrame], tuple]) -> list[tuple]:
    """``measure`` of a k-means fit for each k from 2 on; fits share one kept vector column.

    Of ``MERGE_ROWS`` rows or more, of which at least half repeat others in all features, equal ones are merged into one with a weight.
    """
    work = work_names(features)
    ready = feature_vectors(df, features, scale).select("__vec", *work)
    seen = ready.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*work)).alias("different")).first()
    weight = {}
    if seen["rows"] >= MERGE_ROWS and 2 * seen["different"] <= seen["rows"]:
        # stored, so that the fits' many passes have as many tasks as the merged points need
        merged = store(ready.groupBy(*work).agg(F.count("*").cast("double").alias(WEIGHT)), "merged-points")
        ready, weight = VectorAssembler(inputCols=work, outputCol="__vec").transform(merged), {"weightCol": WEIGHT}
    vectors = ready.persist(StorageLevel.MEMORY_AND_DISK)

    def one(k: int) -> tuple:
        model = KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol="cluster", **weight).fit(vectors)
        return (k, *measure(model, vectors))

    try:
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            return list(pool.map(one, range(2, max_k + 1)))
    finally:
        vectors.unpersist()


def cost(model: KMeansModel, _: DataFrame) -> tuple[float]:
    return (float(model.summary.trainingCost),)


def mean_silhouette(model: KMeansModel, vectors: DataFrame) -> tuple[float]:
    if WEIGHT in vectors.columns:
        return (merged_silhouette(model.transform(vectors)),)
    evaluator = ClusteringEvaluator(featuresCol="__vec", predictionCol="cluster",
                                    distanceMeasure="squaredEuclidean")
    return (float(evaluator.evaluate(model.transform(vectors))),)


def merged_silhouette(placed: DataFrame) -> float:
    """The evaluator's measure, where a row stands for ``WEIGHT`` equal points.

    The evaluator has weights too, but leaves a point's whole weight out of its own cluster's size instead of 1.
    """
    work = [c for c in placed.columns if c not in ("__vec", "cluster", WEIGHT)]
    square = sum((F.col(c) * F.col(c) for c in work[1:]), F.col(work[0]) * F.col(work[0]))
    w = F.col(WEIGHT)
    groups = placed.groupBy("cluster").agg(
        F.sum(w).alias("n"), F.sum(square * w).alias("s"), *[F.sum(F.col(c) * w).alias(c) for c in work]).collect()  # a row for each of k
    if len(groups) < 2:
        raise ValueError("a silhouette needs two clusters at least")
    far = {r["cluster"]: square + F.lit(r["s"] / r["n"]) - 2 * sum((F.col(c) * (r[c] / r["n"]) for c in work[1:]), F.col(work[0]) * (r[work[0]] / r["n"])) for r in groups}
    own, others = F.lit(None).cast("double"), []
    for r in groups:
        mine = F.col("cluster") == r["cluster"]
        # a cluster of one point has no distance
        own = F.when(mine, far[r["cluster"]] * (r["n"] / (r["n"] - 1)) if r["n"] > 1 else F.lit(None).cast("double")).otherwise(own)
        others.append(F.when(~mine, far[r["cluster"]]))
    rated = placed.select(WEIGHT, own.alias("a"), F.array_min(F.array(*others)).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return float(rated.agg(F.sum(score * w) / F.sum(w)).first()[0])


def exact_silhouette(model: KMeansModel, vectors: DataFrame) -> tuple[float]:
    work = [c for c in vectors.columns if c not in ("__vec", WEIGHT)]
    placed = model.transform(vectors).drop("__vec")
    return (float(silhouette_exact(placed, work, "cluster", weight=WEIGHT if WEIGHT in vectors.columns else None).first()["silhouette"]),)


def wcss_curve(df: DataFrame, features: Sequence[str], max_k: int = 10, scale: bool = True,
               seed: int = 42) -> DataFrame:
    """Within-cluster sum of squares for k = 2..max_k."""
    rows = fitted_curve(df, features, max_k, scale, seed, cost)
    return df.sparkSession.createDataFrame(rows, "k int, wcss double")


def silhouette_curve(df: DataFrame, features: Sequence[str], max_k: int = 10, scale: bool = True,
                     seed: int = 42, exact: bool = False) -> DataFrame:
    """Mean silhouette for k = 2..max_k.

    In squared distances, at a cost linear in the rows; ``exact`` takes plain distances (see ``silhouette_exact``).
    """
    measure = exact_silhouette if exact else mean_silhouette
    rows = fitted_curve(df, features, max_k, scale, seed, measure)
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


def optimal_k(df: DataFrame, features: Sequence[str], max_k: int = 10, scale: bool = False,
              seed: int = 42, exact: bool = False) -> DataFrame:
    """The elbow's and the silhouette's choice of k, from one fit per k on unscaled features.

    Differences of the cost within rounding (``elbow_k``'s ``tolerance``) are no bend, and of silhouettes that agree to nine digits the smallest k counts.
    """
    measure = exact_silhouette if exact else mean_silhouette
    rows = fitted_curve(df, features, max_k, scale, seed, lambda m, v: (*cost(m, v), *measure(m, v)))
    curve = df.sparkSession.createDataFrame(
        [("all", *r) for r in rows], "curve string, k int, wcss double, silhouette double")
    even = curve.withColumn("silhouette", F.round("silhouette", 9))
    return elbow_k(curve, ["curve"], tolerance=ROUNDING).join(silhouette_k(even, ["curve"]), "curve").drop("curve")


def kmeans_wcss(df: DataFrame, features: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """Sum of squared distances to the own centre and row count, per cluster."""
    placed = nearest_center(df, features, centers).where(F.col("cluster").isNotNull())
    own = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("cluster"))
    distance = squared_distance([F.col(f) for f in features], own)
    return placed.groupBy("cluster").agg(F.count("*").alias("n_jobs"), F.sum(distance).alias("wcss"))


def packed(features: list[str], share: pd.DataFrame) -> pd.DataFrame:
    """The points of a share as one row: features, label and weight in binary."""
    return pd.DataFrame({"share": share["share"].iloc[:1], "points": [share[[*features, "label", "weight"]].to_numpy(dtype=float).tobytes()]})


def members(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of some points, and each point's weight in the column of its own."""
    labels, member = np.unique(points[:, -2], return_inverse=True)
    weights = np.zeros((len(points), len(labels)))
    weights[np.arange(len(points)), member] = points[:, -1]
    return labels, weights


def cell_sums(width: int, tile_points: int, cell: pd.DataFrame) -> pd.DataFrame:
    """For the points of one share or of two, the summed distances to the others' clusters, in both directions.

    The cell's distances are made once, in blocks that stay in a core's cache, and added up along both sides.
    """
    sides = [(s, np.frombuffer(p).reshape(-1, width)) for s, p in sorted(zip(cell["share"], cell["points"]))]
    # a pair of shares of which one is empty has nothing to add; a share with itself needs one direction only
    if len(sides) < 2 and not cell["alone"].iloc[0]:
        return totals_of([])
    (_, here), (_, there) = sides[0], sides[-1]
    (mine, weight), (theirs, other) = members(here), members(there)
    to_right, to_left = np.zeros((len(here), len(theirs))), np.zeros((len(there), len(mine)))
    axes = [np.ascontiguousarray(points[:, :-2].T) for points in (here, there)]
    columns = min(tile_points, BLOCK_COLUMNS)
    square, step = np.empty((BLOCK_ROWS, columns)), np.empty((BLOCK_ROWS, columns))
    for at in range(0, len(here), BLOCK_ROWS):
        rows = slice(at, min(at + BLOCK_ROWS, len(here)))
        for to in range(0, len(there), columns):
            cols = slice(to, min(to + columns, len(there)))
            away, apart = [x[:rows.stop - at, :cols.stop - to] for x in (square, step)]
            away[:] = 0.0
            for x, y in zip(*axes):
                np.subtract(x[rows, None], y[None, cols], out=apart)
                np.multiply(apart, apart, out=apart)
                np.add(away, apart, out=away)
            np.sqrt(away, out=away)
            to_right[rows] += away @ other[cols]
            if len(sides) == 2:
                to_left[cols] += away.T @ weight[rows]
    if len(sides) == 1:
        return totals_of([(*sides[0], theirs, to_right, True)], tile_points)
    return totals_of([(*sides[0], theirs, to_right, False), (*sides[1], mine, to_left, False)], tile_points)


def totals_of(sides: list[tuple], tile_points: int = TILE_POINTS) -> pd.DataFrame:
    """A row for every ``tile_points`` points of a share: the clusters and the points' totals to these; label and weight come once, from the share's own cell."""
    rows = [(share, at // tile_points, labels.tobytes(), totals[at:at + tile_points].tobytes(), points[at:at + tile_points, -2:].tobytes() if own else None)
            for share, points, labels, totals, own in sides for at in range(0, len(points), tile_points)]
    return pd.DataFrame(rows, columns=["share", "chunk", "labels", "totals", "own"])


def chunk_scores(sizes: dict[float, int], parts: pd.DataFrame) -> pd.DataFrame:
    """Jobs and summed silhouettes of one chunk of points, from its totals in all cells."""
    own = np.frombuffer(next(x for x in parts["own"] if x is not None)).reshape(-1, 2)
    size = np.array(list(sizes.values()), dtype=float)
    column = {label: i for i, label in enumerate(sizes)}
    total = np.zeros((len(own), len(sizes)))
    for labels, sums in zip(parts["labels"], parts["totals"]):
        at = [column[x] for x in np.frombuffer(labels)]
        total[:, at] += np.frombuffer(sums).reshape(len(own), -1)
    mine = np.array([column[x] for x in own[:, 0]])
    every = np.arange(len(own))
    with np.errstate(divide="ignore", invalid="ignore"):
        a = total[every, mine] / (size[mine] - 1)
        mean = total / size
        mean[every, mine] = np.inf
        b = mean.min(axis=1)
        most = np.maximum(a, b)
        score = np.where((size[mine] == 1) | (most == 0) | (len(sizes) == 1), 0.0, (b - a) / most)
    return pd.DataFrame({"n_jobs": [int(own[:, 1].sum())], "score": [float((score * own[:, 1]).sum())]})


def tile_count(n: int, tasks: int, tile_points: int) -> int:
    """Tiles of ``n`` points: enough cells for all tasks, none with fewer than ``TILE_ROWS`` points, none with more than ``tile_points``."""
    wanted = int(np.ceil(np.sqrt(4 * tasks)))
    return max(1, -(-n // tile_points), min(wanted, n // TILE_ROWS))


def silhouette_exact(df: DataFrame, features: Sequence[str], label: str,
                     tile_points: int = TILE_POINTS, weight: str | None = None) -> DataFrame:
    """Mean Euclidean silhouette of given integer labels over the whole frame; with ``weight``, a row stands for so many equal points.

    The measure needs the distances between all distinct points. Equal points
    are merged into weighted ones first; the rest is cut into p shares, whose pairs, each taken once, are the
    p * (p + 1) / 2 cells of a triangle. A share goes to its p cells as one packed row, and a cell adds the distances up for both of its
    shares: no pairs of points are emitted. The shares follow the tasks, not ``tile_points``, so that what is shuffled grows with the
    points, not with their square; inside a cell no more than ``tile_points`` are compared with a block of rows at once, and totals leave it in
    chunks of as many. The work grows with the square of the distinct points: for large
    traces ``silhouette_curve`` uses the linear-cost measure.
    """
    features, spark = list(features), df.sparkSession
    named = df.where(F.col(label).isNotNull()).na.drop("any", subset=features).select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias("label"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight"))
    points = store(named.groupBy(*features, "label").agg(F.sum("weight").alias("weight")), "silhouette-points")
    sizes = {float(r["label"]): r["size"] for r in points.groupBy("label").agg(F.sum("weight").alias("size")).collect()}  # a row per cluster
    most = max(TILE_ROWS, min(SHARE_POINTS, SHARE_TOTALS // max(1, len(sizes))))
    n_shares = tile_count(points.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), most)
    shared = points.withColumn("share", F.pmod(F.xxhash64(*features, "label"), F.lit(n_shares)).cast("int"))
    shares = store(shared.groupBy("share").applyInPandas(lambda share: packed(features, share), "share int, points binary"), "silhouette-shares")
    dealt = shares.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1)))).select(
        "share", "points", (F.col("share") == F.col("with")).alias("alone"),
        F.least("share", "with").alias("low"), F.greatest("share", "with").alias("high"))
    width = len(features) + 2
    # a cell for each task: by size alone, adaptive execution would gather the small packed rows in few tasks
    cells = dealt.repartition(n_shares * (n_shares + 1) // 2, "low", "high")
    sums = cells.groupBy("low", "high").applyInPandas(
        lambda cell: cell_sums(width, tile_points, cell), "share int, chunk int, labels binary, totals binary, own binary")
    scores = sums.groupBy("share", "chunk").applyInPandas(lambda parts: chunk_scores(sizes, parts), "n_jobs long, score double")
    return scores.agg(F.sum("n_jobs").alias("n_jobs"), (F.sum("score") / F.sum("n_jobs")).alias("silhouette"))
