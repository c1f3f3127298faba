import numpy as np
import pytest
from pyspark.sql import functions as F

from siltlog.llm import kdtree


def brute_force(rows, k):
    out = []
    whole = [(i, np.floor(64 * np.array(v, dtype=np.float64))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    for i, v in whole:
        if i % 20 == 0:
            scores = sorted((-int(v @ w), j) for j, w in whole if j != i and len(w) == len(v))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, shard_rows", [(5, 100), (20, 8192)])
def test_same_as_all_scores(spark, monkeypatch, k, shard_rows):
    rng = np.random.default_rng(k)
    monkeypatch.setattr(kdtree, "SHARD_ROWS", shard_rows)
    vectors = rng.normal(size=(400, 6)).round(1)
    vectors[50:90] = vectors[49]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (420, [1.0, 2.0]), (421, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, `shard` int")
    found = kdtree.top_k(df, F.col("vec_id") % 20 == 0, k)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, k)


def test_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (None, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in kdtree.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert kdtree.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_boxes_bound_every_leaf():
    points = np.random.default_rng(2).normal(size=(1000, 4))
    order, ends, low, high = kdtree.build_tree(points, 64)
    assert sorted(order) == list(range(1000)) and len(low) == 2 * len(ends) - 1
    starts = np.concatenate([[0], ends[:-1]])
    for i, (a, b) in enumerate(zip(starts, ends)):
        leaf, box = points[order[a:b]], len(ends) - 1 + i
        assert (leaf.min(axis=0) == low[box]).all() and (leaf.max(axis=0) == high[box]).all()
