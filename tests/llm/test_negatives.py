import numpy as np
import pytest
from pyspark.sql import functions as F

from siltlog.llm import negatives


def brute_force(rows, k, percent, every):
    whole = [
        (i, np.floor(256 * np.array(v, dtype=np.float64)), y)
        for i, v, y in rows
        if y is not None and v is not None and None not in v and np.isfinite(v).all()
    ]
    out = []
    for i, v, y in whole:
        if i % every == 0:
            scored = sorted((-int(v @ w), j, z) for j, w, z in whole if j != i and len(w) == len(v))
            for s, j, _ in [x for x in scored if x[2] == y][:k]:
                inside = [(t, n) for t, n, z in scored if z != y and percent * -s <= 100 * -t <= 100 * -s]
                out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(inside[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, percent, rows_of_shard, together", [(5, 80, 4096, 4096), (3, 50, 40, 7), (1, 0, 64, 2)])
def test_same_as_all_scores(spark, monkeypatch, k, percent, rows_of_shard, together):
    rng = np.random.default_rng(k)
    monkeypatch.setattr(negatives, "shard_rows", lambda rows: rows_of_shard)
    monkeypatch.setattr(negatives, "ANCHORS_TOGETHER", together)
    monkeypatch.setattr(negatives, "SCORES_AT_ONCE", 1000)
    vectors = rng.normal(size=(400, 4)).round(1)
    vectors[50:130] = vectors[49]  # ties, in many labels
    labels = np.where(rng.random(400) < 0.4, 0, rng.integers(0, 30, 400))
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(vectors, labels))]
    rows += [(400, None, 1), (405, [1.0, None, 1.0, 1.0], 1), (410, [float("nan")] * 4, 1), (415, [float("inf")] * 4, 1), (420, [1.0] * 4, None)]
    rows += [(425, [1.0, 2.0], 1), (426, [1.0, 1.9], 1), (427, [1.0, 1.8], 2), (430, [], 1), (431, [], 1), (432, [], 3)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, slot int").repartition(6)
    found = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, k, percent)
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, k, percent, 5)


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (0, [0.9], 2), (1, [0.95], 1), (1, [0.95], 1), (2, [0.8], 2), (2, [0.9], 2), (None, [0.9], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = negatives.hard_negatives(df, F.col("vec_id") == 0)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in found.collect())
    # The id 0 stands for two rows: one of label 1, which has a positive below it, one of label 2.
    assert [g for g in got if g[1] == 1] == [(0, 1, 1, 0), (0, 1, 2, 2), (0, 1, 3, 2)]
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_slots_are_disjoint_and_hold_what_windows_want():
    rng = np.random.default_rng(3)
    limits = -np.sort(-rng.integers(-20, 100, size=(30, 4)).astype(float), axis=1)
    limits[5:9, 2:] = -np.inf
    scores = rng.integers(-40, 110, size=(30, 50)).astype(float)
    row, column, slot = negatives.slots(scores, limits, 80)
    held = set(zip(row.tolist(), column.tolist()))
    assert len(held) == len(row)
    for r in range(30):
        for c in range(50):
            s = scores[r, c]
            wanted = any(80 * u <= 100 * s <= 100 * u for u in limits[r] if u > -np.inf)
            assert not wanted or (r, c) in held
    assert all(limits[r, j] >= scores[r, c] and (j == 3 or limits[r, j + 1] < scores[r, c]) for r, c, j in zip(row, column, slot))
