import math
import os

import numpy as np
import pytest

from plumbline.llm import knn


def plain(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


def run(spark, rows, tmp_path, name="sf"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return sorted(tuple(r) for r in knn.op9_knn(spark, path).select("query_id", "rank", "vec_id", "score").collect())


def test_query_against_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(int(i), [1.0] * 8) for i in range(400, 480)]  # one very common vector: ties
    rows += [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, []), (701, []), (750, [1.0, 2.0]), (751, [3.0, 4.0]), (None, [1.0] * 8)]
    rows += [(50, rng.normal(size=8).tolist()), (3, rows[3][1]), (800, [1e6] * 8)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_small_blocks_and_pruning(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 4)) * 20
    rows = [(int(i), (near[i % 6] + rng.normal(size=4) * 0.05).astype(np.float32).tolist()) for i in range(600)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = knn.knn_join(data.where("id % 50 = 0"), data, n_pivots=12, block_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    assert knn.share(data.where("id % 50 = 0"), data, n_pivots=12, block_rows=40) < 0.4


def test_bounds_hold_and_leave_cells_out():
    rng = np.random.default_rng(4)
    for spread, dims in ((5, 3), (200, 8)):
        centre = np.unique(np.round(rng.normal(size=(12, dims)) * 200), axis=0)
        x = np.round(centre[rng.integers(12, size=300)] + rng.normal(size=(300, dims)) * spread).astype(np.int64)
        gaps = np.sqrt(((x[:, None] - centre[None]) ** 2).sum(2))
        cell, far, norm = gaps.argmin(1), gaps.min(1), np.sqrt((x**2).sum(1))
        summary = [(dims, int(c), int((cell == c).sum()), far[cell == c].min(), far[cell == c].max(), norm[cell == c].max()) for c in np.unique(cell)]
        plan = knn.Plan(summary, {dims: centre}, 40)
        q, bound, scores = x[:50], plan.bounds(dims, x[:50], cell[:50]), x[:50] @ x.T
        for j, c in enumerate(plan.by_dim[dims][0]):
            assert (scores[:, cell == c].max(1) <= bound[:, j]).all()
        floor = np.sort(scores, axis=1)[:, -6].astype(float)
        visits = plan.visits(dims, q, cell[:50], floor)
        if spread == 5:
            assert np.mean([len(v) for v in visits]) < 0.5 * max(b + n for b, n in plan.blocks.values())


def test_share_of_the_embeddings_that_is_scored(spark):
    """These vectors are spread evenly over 64 dimensions: bounds spare next to nothing, which the README states."""
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    data = knn.quantized(spark.read.parquet(path))
    assert 0.9 < knn.share(data.where("id % 50 = 0"), data, block_rows=50) <= 1


def test_few_and_no_rows(spark, tmp_path):
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])], tmp_path, "a") == [(0, 1, 1, 3 * 65536)]
    assert run(spark, [], tmp_path, "b") == []


def test_ids_of_several_rows_in_small_blocks(spark):
    rows = [(0, [10.0, float(y)]) for y in (0, 0, 0)] + [(i, [9.0 - i, 0.0]) for i in range(1, 8)] + [(50, [-8.0, 1.0])] * 4 + [(i, [-1.0 * i / 20, 1.0]) for i in range(100, 130)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = knn.knn_join(data.where("id % 50 = 0"), data, n_pivots=64, block_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_values_beyond_whole_doubles(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, -1.0]), (2, [-3e15, 4.0]), (50, [1.0, 2.0]), (51, [1e12, 1e3])]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in knn.knn_join(data.where("id % 50 = 0"), data).collect()}
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    for (q, i), score in got.items():
        assert score == max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[i], strict=True))))
    assert len(got) == 8
