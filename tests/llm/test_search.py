import numpy as np
import pytest
from pyspark.sql import functions as F

from jobcast.llm import metric_tree


def brute(rows, asked, k):
    out = []
    for q, v in rows:
        if q in asked:
            scores = sorted((-int(np.dot(np.array(v, object), np.array(w, object))), i) for i, w in rows if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "alike"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(metric_tree, "SUBTREE_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-50, 50, 6) if kind == "spread" or i % 3 else np.full(6, 7)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    got = metric_tree.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)


def test_repeated_ids_and_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "SUBTREE_ROWS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 3).tolist()) for i in range(1300)]
    df = spark.createDataFrame(rows + rows[1:4], "vec_id long, embedding array<long>")
    got = metric_tree.top_k(df, df.where("vec_id <> 1"), 2).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.score)
    for q, v in rows[5:200]:
        best = sorted((-int(np.dot(v, w)) for i, w in rows + rows[1:4] if i != q))[:2]
        assert by[q] == [-s for s in best]


def test_odd_vectors(spark):
    rows = [(0, [1.0, float("nan")]), (20, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [0.25, -1.0]), (4, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    v = metric_tree.scaled(df, 64)
    got = metric_tree.top_k(v, v.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 4, 2048), (20, 2, 3, 16 * 32 - 64 * 32)]
    assert metric_tree.top_k(v.limit(0), v.limit(0), 5).count() == 0
