import random

import pytest
from pyspark.sql import functions as F

from jobcast.operators.dictionary import encode_with, grow_dictionary
from jobcast.operators.encode import label_encode
from jobcast.plans import train as T
from jobcast.plans.models import StoredModels
from jobcast.session import fresh_path
from jobcast.sources.versions import Versions


def test_a_version_is_seen_whole_or_not_at_all(spark):
    versions = Versions(spark, fresh_path(spark, "versions"))
    assert versions.newest() is None and versions.published() == []
    with pytest.raises(ValueError):
        versions.table("t")
    names = []
    for n in (1, 2, 3):
        names.append(versions.begin())
        spark.range(n).write.parquet(versions.folder(names[-1]) + "/t")
        if n < 3:  # the third writer stops before it publishes
            versions.publish(names[-1])
            assert versions.table("t").count() == n
    assert versions.newest() == names[1] and versions.table("t").count() == 2 and versions.table("t", names[0]).count() == 1
    assert versions.clean() == [names[0], names[2]] and versions.table("t").count() == 2
    assert versions.begin() > names[1] and versions.parts(names[1]) == ["t"]


def test_first_batch_gets_the_codes_of_label_encode(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", None, "10", "9", "é", ""]), rng.choice([3.5, -1.0, float("nan"), None, 2.0]), rng.choice([10, 9, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s string, d double, n int")
    for as_string in (False, True):
        root = fresh_path(spark, "dictionary")
        grow_dictionary(df, ["s", "d", "n"], root, as_string)
        got = encode_with(df, ["s", "d", "n"], root).orderBy("i").collect()
        want = label_encode(df, ["s", "d", "n"], as_string).orderBy("i").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_codes_never_change_and_new_values_come_behind(spark, max_rows):
    rng = random.Random(2)
    root, plain, columns = fresh_path(spark, "dictionary"), {"s": {}, "n": {}}, "i int, s string, n long, extra string"
    versions = []
    for batch in range(4):
        rows = [(i, rng.choice([None, *[f"v{rng.randrange(20 * batch + 5)}"]]), rng.choice([None] * (batch > 1) + [rng.randrange(30)]), "x") for i in range(100)]
        df = spark.createDataFrame(rows, columns)
        versions.append(grow_dictionary(df, ["s", "n"], root))
        for at, c in ((1, "s"), (2, "n")):
            for v in sorted({r[at] for r in rows} - set(plain[c]), key=lambda v: (v is None, v)):
                plain[c][v] = len(plain[c])
        got = {r.i: (r.s, r.n, r.extra) for r in encode_with(df, ["s", "n"], root, max_rows=max_rows).collect()}
        assert got == {i: (plain["s"][s], plain["n"][n], e) for i, s, n, e in rows}
    assert versions == sorted(set(versions)) and grow_dictionary(df, ["s", "n"], root) == versions[-1]
    old = encode_with(spark.createDataFrame([(1, "v70", 3, ""), (2, None, None, "")], columns), ["s", "n"], root, version=versions[0]).orderBy("i").collect()
    assert old[0].s == -1 and old[1].n == -1 and old[0].n in (-1, plain["n"].get(3))
    with pytest.raises(ValueError, match="no columns"):
        encode_with(df, ["extra"], root)
    assert encode_with(df.limit(0), ["s"], root).count() == 0
    grow_dictionary(df.limit(0), ["s", "n"], root)
    empty = fresh_path(spark, "dictionary")
    grow_dictionary(df.limit(0), ["s"], empty)
    assert Versions(spark, empty).newest() is not None


def jobs(spark, n=400):
    return spark.range(n).selectExpr(
        "id as job_id", "if(id % 40 = 39, null, double(1 + id % 5)) as nodes", "double(id % 2 * 1000) as queue",
        "(1 + id % 5) * if(id % 2 = 0, 100.0D, 1000.0D) as y", "timestamp_ntz'2024-01-01' as window_start")


def test_models_are_read_for_one_group_at_a_time(spark, monkeypatch):
    """Scoring loads a group's models when its turn comes; a trained store holds folders, not models."""
    root = fresh_path(spark, "models")
    centers = spark.createDataFrame([(i, [3.0, 1000.0 * i]) for i in (0, 1)], "cluster int, center array<double>").withColumn(
        "window_start", F.expr("timestamp_ntz'2024-01-01'"))
    trained = T.train_variants(jobs(spark), ["nodes", "queue"], "y", ["clustering_rf", "clustering_xgb"], "one_tree", centers=centers, root=root)
    assert len(trained.folders) == 4 and all(isinstance(f, str) for f in trained.folders.values())
    again, held = StoredModels(spark, root), []
    load = StoredModels.of
    monkeypatch.setattr(StoredModels, "of", lambda self, group: held.append(group) or load(self, group))
    preds = T.predict_per_cluster(jobs(spark).withColumn("cluster", F.lit(9)), again, ["none"]).collect()  # placed anew
    assert sorted(held) == again.groups() and len(preds) == 2 * jobs(spark).where("nodes is not null").count()
    assert all(r.cluster == r.job_id % 2 and abs(r.pred - r.act) < 1e-6 * r.act for r in preds)


def test_a_failed_training_leaves_the_old_version(spark, monkeypatch):
    root = fresh_path(spark, "models")
    rows = jobs(spark).withColumn("cluster", (F.col("job_id") % 2).cast("int"))
    first = T.train_cluster_rf(rows, ["nodes"], "y", "one_tree", root=root)
    monkeypatch.setattr(T, "underpred_bias", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        T.train_cluster_rf(rows, ["nodes"], "y", "one_tree", root=root)
    assert StoredModels(spark, root).version == first.version and first.centers is None
    with pytest.raises(ValueError, match="enough rows"):
        T.train_cluster_rf(rows.limit(0), ["nodes"], "y", "one_tree", root=root)
