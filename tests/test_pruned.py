"""The pruned top-k has the rows of the plain one, and multiplies fewer blocks where there are clusters."""

import numpy as np
import pytest

from lexalign.operators import knn, pruned


def frame(spark, m, bias=None):
    rows = [(1000 + 3 * i, v.tolist(), float(bias[i]) if bias is not None else 0.0) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "idx bigint, vec array<double>, b double")


def same(spark, x, z, k, block, bias=None, alpha=1.0):
    left, right = frame(spark, x), frame(spark, z, bias)
    options = {"right_bias": "b", "alpha": alpha} if bias is not None else {}
    found = pruned.topk(left, right, k, block=block, **options)
    got = sorted((r.l_idx, r["rank"], r.r_idx, round(r.score, 9)) for r in found.rows.collect())
    want = sorted((r.l_idx, r["rank"], r.r_idx, round(r.score, 9)) for r in knn.topk(left, right, k, block=64, **options).collect())
    assert got == want
    return found


def clusters(rng, n, n_clusters=12, dim=8, spread=0.05):
    centres = rng.normal(size=(n_clusters, dim)) * 3
    return centres[rng.integers(0, n_clusters, n)] + spread * rng.normal(size=(n, dim))


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(0)
    x = clusters(rng, 900)
    found = same(spark, x[:500], x[400:], 5, 25)
    assert found.computed < 0.5 * found.pairs and len(found.rounds) >= 2
    bias = rng.normal(size=500)
    found = same(spark, x[:500], x[400:], 5, 25, bias, 2.0)
    assert found.computed < 0.7 * found.pairs


@pytest.mark.parametrize("k", [1, 7, 400])
def test_random_vectors_ties_and_few_rows(spark, k):
    rng = np.random.default_rng(k)
    found = same(spark, rng.normal(size=(60, 4)), rng.normal(size=(300, 4)), k, 20)
    assert len(found.rounds) <= 3                                       # it does not pay: the rest goes in one round
    same(spark, np.round(rng.normal(size=(50, 2))), np.round(rng.normal(size=(200, 2))), k, 20)      # many equal scores
    same(spark, rng.normal(size=(3, 4)), rng.normal(size=(2, 4)), k, 20)


def test_one_vector_is_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    z = np.concatenate([rng.normal(size=(200, 4)), np.tile(rng.normal(size=4), (100, 1)), np.zeros((5, 4))])
    same(spark, z[150:250], z, 6, 16)
    balls = pruned.make_balls(frame(spark, z), len(z), 16)
    assert balls.n.sum() == len(z) and balls.n.max() <= 60 and len(balls.n) <= pruned.MOST_BALLS


def test_empty_sides(spark):
    some = frame(spark, np.eye(3))
    assert pruned.topk(some.limit(0), some, 3).rows.collect() == [] and pruned.topk(some, some.limit(0), 3).rows.collect() == []
