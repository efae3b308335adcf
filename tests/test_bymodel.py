"""Searches under many models at once against a search a model; what a grid writes does not grow with its models."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalign.operators import bymodel
from lexalign.operators import mapping as M
from lexalign.operators import retrieval as R
from lexalign.plans import grid, registry
from lexalign.plans import spaces as SP
from lexalign.session import ensure_checkpoint_dir
from tests.conftest import SF0001


def _maps(rng, models, d, e, apart, rank=4):
    """Maps of models that are ``apart`` from each other, each in a latent space turned at random; the last one of lower rank."""
    base = rng.normal(size=(d, rank)), rng.normal(size=(e, rank))
    out = []
    for _ in range(models):
        turn = np.linalg.qr(rng.normal(size=(rank, rank)))[0]
        out.append(tuple((m + apart * rng.normal(size=m.shape)) @ turn for m in base))
    if models > 1:
        out[-1] = tuple(m[:, :2] for m in out[-1])
    return out


def _plain(maps, ids, x, rid, y, bias, k, alpha):
    for m, (left, right) in enumerate(maps):
        s = alpha * M.map_rows(x, left, True) @ M.map_rows(y, right, True).T + bias[:, m]
        for u in np.unique(ids):
            yield m, int(u), sorted((float(-v), int(o)) for i in np.flatnonzero(ids == u) for v, o in zip(s[i], rid))[:k]


@pytest.mark.parametrize("apart", [0.0, 1e-6, 1e-2, 1.0])
@pytest.mark.parametrize("odd", [False, True])
def test_blocks_hold_the_best_of_every_model(apart, odd):
    rng = np.random.default_rng(int(1e6 * apart) + odd)
    d, e, n, m, k = 6, 5, 150, 900, 7
    maps = _maps(rng, 4, d, e, apart)
    x, y, bias = rng.normal(size=(n, d)), rng.normal(size=(m, e)), -rng.random((m, 1)) + apart * 0.01 * rng.normal(size=(m, 4))
    ids, rid = rng.permutation(n), rng.permutation(m)
    if odd:                      # equal vectors, repeated ids, a zero vector, rows that are not finite
        x, y[:m // 2], bias[:m // 2], ids = np.round(x), y[0], bias[0], np.where(ids < 20, ids // 2, ids)
        x[3], y[m - 1], y[m - 2] = 0.0, np.nan, 0.0
    b = bymodel._Block({side: {i: pair[side] for i, pair in enumerate(maps)} for side in (0, 1)}, ids, x, k, 2.0)
    for part in np.split(rng.permutation(m), [40, 300, 301]):
        b.add(rid[part], y[part], bias[part])
    if not odd:
        assert (len(b.groups) == 2) == (apart < 0.1)             # near models share a product, the one of lower rank has its own
    real = np.isfinite(y).all(axis=1)
    found = [{}, {}, {}, {}]
    for i in range(4):
        for key, other, score in zip(*b.lists(i)):
            found[i].setdefault(int(key), []).append((float(score), int(other)))
    for i, u, want in _plain(maps, ids, x, rid[real], y[real], bias[real], k, 2.0):
        got = found[i][u]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-9)
        if not odd:
            assert [o for _, o in got] == [o for _, o in want]
        alike = sorted(rid[:m // 2])
        mine = [o for _, o in got if o in set(alike)]
        if odd and u >= 10:
            assert mine == alike[:len(mine)]                     # ties go to the lower id, whatever the chunk


def test_many_within_the_bounds_are_settled_in_double(monkeypatch):
    monkeypatch.setattr(bymodel.knn, "HELD", 1000)
    rng = np.random.default_rng(5)
    maps = _maps(rng, 2, 3, 3, 0.0)[:1] * 2
    x, y = np.tile(rng.normal(size=3), (5, 1)) + 1e-9 * rng.normal(size=(5, 3)), np.tile(rng.normal(size=3), (4000, 1)) + 1e-9 * rng.normal(size=(4000, 3))
    b = bymodel._Block({side: {i: pair[side] for i, pair in enumerate(maps)} for side in (0, 1)}, np.arange(5), x, 3, 1.0)
    b.add(np.arange(4000), y, np.zeros((4000, 2)))
    s = M.map_rows(x, maps[0][0], True) @ M.map_rows(y, maps[0][1], True).T
    for i in range(2):
        assert np.allclose(b.lists(i)[2].reshape(5, 3), -np.sort(-s, axis=1)[:, :3], rtol=0, atol=1e-15)


def _tables(spark, rng, sizes, dim, shift=0):
    rows = [(s, i, f"w{i}", rng.normal(size=dim).tolist()) for s, n in sizes.items() for i in range(shift, shift + n)]
    return spark.createDataFrame(rows, "space bigint, idx bigint, word string, vec array<double>")


def test_late_maps_are_the_mapped_tables(spark):
    rng = np.random.default_rng(1)
    x, z = _tables(spark, rng, {0: 130, 3: 70, 4: 9}, 6), _tables(spark, rng, {0: 90, 3: 200, 4: 9}, 5)
    found = {s: _maps(rng, 3, 6, 5, apart) for s, apart in ((0, 1e-5), (3, 1.0), (8, 1.0))}      # 4 has no maps, 8 no rows
    maps = [spark.createDataFrame([(s, m, i, row.tolist()) for s, all_ in found.items() for m, pair in enumerate(all_) for i, row in enumerate(pair[side])],
                                  "space bigint, model int, i int, row array<double>") for side in (0, 1)]
    late = [M.apply_keyed(df, m, unit=True, late=True) for df, m in zip((x, z), maps)]
    plain = []
    for df, m in zip((x, z), maps):
        models = m.select("space", "model").distinct()
        number = F.col("space") * 10 + F.col("model")
        counts = {10 * s + i: 200 for s in found for i in range(3)}
        plain.append(M.apply_keyed(df.join(models, "space").withColumn("space", number), m.withColumn("space", number), counts, 6, unit=True))
    r_z, each = R.nbr_mean(late[1], late[0], 4, space="space"), R.nbr_mean(plain[1], plain[0], 4, space="space")
    got = {(10 * r.space + m, r.idx): v for r in r_z.collect() for m, v in enumerate(r.r)}
    want = {(r.space, r.idx): r.r for r in each.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[key], want[key], atol=1e-12) for key in want)
    for a, b in ((R.csls_topk(*late, r_z, 5, space="space"), R.csls_topk(*plain, each, 5, space="space")),
                 (R.nn_topk(*late, 5, space="space"), R.nn_topk(*plain, 5, space="space"))):
        mine = {(10 * r.space + r.model, r.src_idx, r["rank"]): (r.trg_idx, r.score) for r in a.collect()}
        theirs = {(r.space, r.src_idx, r["rank"]): (r.trg_idx, r.score) for r in b.collect()}
        assert mine.keys() == theirs.keys() and len(mine) == 3 * 5 * 200
        assert all(mine[key][0] == theirs[key][0] and np.isclose(mine[key][1], theirs[key][1], atol=1e-12) for key in theirs)
    tests = spark.createDataFrame([(s, f"w{i}", f"w{i + 2}") for s in (0, 3, 4) for i in range(0, 90, 4)], "space bigint, src_word string, trg_word string")
    mine = {10 * r.space + r.model: tuple(r)[2:] for r in SP.evaluate(*late, tests).collect()}
    every = tests.join(maps[0].select("space", "model").distinct(), "space").withColumn("space", F.col("space") * 10 + F.col("model"))
    theirs = {r.space: tuple(r)[1:] for r in SP.evaluate(*plain, every).collect()}
    assert mine == theirs and len(mine) == 6
    with pytest.raises(ValueError):
        M.apply_keyed(x, maps[0], late=True)


def test_a_grid_writes_no_table_a_model(spark):
    langs, pairs, words = registry._keyed_inputs(spark, SF0001)
    train, test = words.where("part = 'train'"), words.where("part = 'test'")
    base = ensure_checkpoint_dir(spark).removeprefix("file:")

    def written(lambdas) -> int:
        """Bytes of the tables that a grid leaves, but for its maps."""
        def tables():
            return {os.path.join(at, name) for at, _, names in os.walk(f"{base}/tables") for name in names if "/models-" not in at}
        before = tables()
        rows = grid.grid(langs, pairs.where("space = 0"), train.where("space = 0"), test, lambdas=lambdas).collect()
        assert len(rows) == len(lambdas)
        return sum(os.path.getsize(path) for path in tables() - before)
    assert written((0.1, 1.0, 10.0, 100.0)) < 1.2 * written((1.0,))


def test_left_blocks_fit_memory():
    dim = 64
    cap = bymodel.knn.BLOCK_BYTES // (8 * dim)
    assert bymodel.choose_tasks({0: (10 * cap, 10 * cap)}, 4, dim) == {0: 10}
    assert bymodel.choose_tasks({0: (4000, 4000), 1: (4000, 4000)}, 12, dim) == {0: 6, 1: 6}
    assert bymodel.choose_tasks({0: (3, 5000)}, 12, dim) == {0: 1}
