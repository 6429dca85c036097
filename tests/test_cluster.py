import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobcast.checks import ORACLES, QUERIES
from jobcast.operators import cluster as C
from jobcast.operators.encode import elbow_k

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows + [(999, None, 0.1), (1000, float("inf"), 9.8)], "i int, x double, y double").cache()


def silhouette(points, labels):
    distance = np.linalg.norm(points[:, None] - points, axis=2)
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = distance[i, same].sum() / (same.sum() - 1)
        b = min(distance[i, labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_groups_are_nearest_and_inputs_stay(spark, blobs):
    placed, model = C.kmeans_group_jobs(blobs, FEATURES, 3)
    rows = placed.collect()
    assert placed.columns == ["i", "x", "y", "cluster"] and len(rows) == 182
    centers = np.array(model.clusterCenters())
    finite = [r for r in rows if r["i"] < 999]
    for r in finite:
        assert r["cluster"] == np.argmin(np.linalg.norm(centers - (r["x"], r["y"]), axis=1))
    assert {r["i"]: r["x"] for r in rows}[999] is None  # filled for grouping only
    again = {r["i"]: r["cluster"] for r in C.kmeans_group_jobs(blobs, FEATURES, 3)[0].collect()}
    assert again == {r["i"]: r["cluster"] for r in rows}


def test_checks_features(blobs):
    with pytest.raises(ValueError):
        C.kmeans_group_jobs(blobs, ["x", "z"], 2)


def test_curves_choose_three(blobs):
    wcss = {r["k"]: r["wcss"] for r in C.wcss_curve(blobs, FEATURES, 5).collect()}
    assert list(wcss) == [2, 3, 4, 5] and wcss[2] > wcss[3] > wcss[5] > 0
    for exact in (False, True):
        curve = {r["k"]: r["silhouette"] for r in C.silhouette_curve(blobs, FEATURES, 4, exact=exact).collect()}
        assert max(curve, key=curve.get) == 3
    best = C.optimal_k(blobs, FEATURES, 5).first()
    assert best["silhouette_k"] == 3 and 2 <= best["elbow_k"] <= 5


def test_wcss_of_given_centers(spark, blobs):
    centers = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]
    rows = [(r["x"], r["y"]) for r in blobs.where("i < 999").collect()]
    want = sum(min((x - a) ** 2 + (y - b) ** 2 for a, b in centers) for x, y in rows)
    got = C.kmeans_wcss(blobs.where("i < 999"), FEATURES, centers).agg(F.sum("wcss")).first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tile_points", [7, 4096])
def test_exact_silhouette_against_numpy(spark, tile_points):
    rng = np.random.default_rng(6)
    points = rng.integers(0, 6, size=(150, 2)).astype(float)  # many equal points
    labels = np.where(points[:, 0] < 3, 0, 1)
    labels[0] = 2  # a cluster of one
    rows = [(*map(float, p), int(c)) for p, c in zip(points, labels)]
    df = spark.createDataFrame(rows + [(None, 1.0, 0), (1.0, 1.0, None)], "x double, y double, c int")
    got = C.silhouette_exact(df, FEATURES, "c", tile_points).first()
    assert got["n_jobs"] == 150
    assert got["silhouette"] == pytest.approx(silhouette(points, labels), abs=1e-12)


def test_tuning_query_tries_up_to_ten_groups(spark, sf_dir, monkeypatch):
    def curve(df, features, max_k, *_):
        return [(k, 100.0 / k, 1.0 - abs(k - 8) / 10) for k in range(2, max_k + 1)]

    monkeypatch.setattr(C, "fitted_curve", curve)
    assert QUERIES["optimal_k"](spark, sf_dir).first()["silhouette_k"] == 8


def test_silhouette_query_follows_the_run_times(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("value", F.sqrt(F.abs("value"))).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    curves = [{r["k"]: r["silhouette"] for r in QUERIES["silhouette_curve"](spark, at).collect()} for at in (sf_dir, str(tmp_path))]
    assert all(sorted(c) == list(range(2, 11)) for c in curves)
    assert all(curves[0][k] != curves[1][k] for k in range(2, 11))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert dict(con.execute(ORACLES["silhouette_curve"]).fetchall()) == curves[1]


def test_tiles_follow_tasks_and_points():
    assert C.tile_count(10, 8, 4096) == 1 and C.tile_count(3000, 8, 4096) == 6
    assert C.tile_count(3000, 8, 100) == 30 and C.tile_count(0, 8, 4096) == 1
    assert C.tile_count(10**6, 200, 10**6) == 29  # 435 cells for 200 tasks


def test_rounding_makes_no_elbow(spark):
    rows = [("a", k, 1000.0 * (10 - k) + (1e-8 if k == 5 else 0.0)) for k in range(2, 11)] + [("b", k, float(w)) for k, w in zip(range(2, 8), (100, 60, 50, 10, 9, 8))]
    curves = spark.createDataFrame(rows, "curve string, k int, wcss double")
    assert dict(elbow_k(curves, ["curve"], tolerance=1e-9).collect()) == {"a": 2, "b": 3}
    assert dict(elbow_k(curves, ["curve"]).collect())["a"] > 2


@pytest.mark.parametrize(("share_points", "clusters"), [(300, 3), (500_000, 3), (300, 1), (300, 400)])
def test_exact_silhouette_of_several_shares(spark, monkeypatch, share_points, clusters):
    monkeypatch.setattr(C, "SHARE_POINTS", share_points)
    rng = np.random.default_rng(8)
    points, labels = rng.normal(size=(1100, 3)), rng.integers(0, clusters, size=1100)
    points[:400] = points[400:800]  # equal points, also of other clusters
    df = spark.createDataFrame([(*map(float, p), int(c)) for p, c in zip(points, labels)], "x double, y double, z double, c int")
    got = C.silhouette_exact(df, ["x", "y", "z"], "c", tile_points=100).first()
    want = silhouette(points, labels) if clusters > 1 else 0.0
    assert got["n_jobs"] == 1100 and got["silhouette"] == pytest.approx(want, abs=1e-12)


def test_points_are_dealt_by_tasks_not_by_the_tile(spark, monkeypatch):
    """What is shuffled must not grow with the square of the points: a small tile makes no more copies of them."""
    asked, count = [], C.tile_count
    monkeypatch.setattr(C, "tile_count", lambda *args: asked.append(count(*args)) or asked[-1])
    df = spark.range(3000).select(F.rand(3).alias("x"), F.rand(4).alias("y"), (F.col("id") % 3).cast("int").alias("c"))
    got = [C.silhouette_exact(df, FEATURES, "c", n).first()["silhouette"] for n in (50, 4096)]
    assert asked[0] == asked[1] <= 6 and got[0] == pytest.approx(got[1], abs=1e-12)


def test_exact_silhouette_of_nothing(spark):
    got = C.silhouette_exact(spark.createDataFrame([(None, 0), (1.0, None)], "x double, c int"), ["x"], "c").first()
    assert (got["n_jobs"], got["silhouette"]) == (None, None)


def test_curves_of_merged_points_are_those_of_all(spark, monkeypatch):
    """Equal points become one with a weight: fewer to fit and measure, and the same measures."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.integers(0, 4, size=(150, 2)) / 10 + c for c in ((0, 0), (10, 0), (0, 30))] + [np.array([[90.0, 90.0]])])
    df = spark.createDataFrame([(*map(float, p),) for p in points], "x double, y double").cache()
    found, fitted, fit = [], [], C.KMeans.fit
    monkeypatch.setattr(C.KMeans, "fit", lambda self, rows: fitted.append(rows.count()) or fit(self, rows))
    for least in (C.MERGE_ROWS, 100):
        monkeypatch.setattr(C, "MERGE_ROWS", least)
        for f in (C.wcss_curve, C.silhouette_curve, lambda *a: C.silhouette_curve(*a, exact=True)):
            found.append({r[0]: r[1] for r in f(df, FEATURES, 4).where("k = 4").collect()})
    assert set(fitted[:9]) == {451} and max(fitted[9:]) < 60
    for all_, merged in zip(found[:3], found[3:]):
        assert merged == pytest.approx(all_, abs=1e-9)
