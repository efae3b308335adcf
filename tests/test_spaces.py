"""Many pairs and models in one job against one after the other; rank-limited fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import fit as FT
from lexalign.operators import gram as G
from lexalign.operators import knn
from lexalign.operators import mapping as M
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.plans import bilingual as BL
from lexalign.plans import grid, registry
from lexalign.plans import spaces as SP
from tests.conftest import SF0001


def _vectors(spark, rng, sizes, dim=5):
    rows = [(s, i, f"w{i}", rng.normal(size=dim).tolist()) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "space bigint, idx bigint, word string, vec array<double>")


def test_keyed_topk_is_the_topk_of_every_space(spark):
    rng = np.random.default_rng(0)
    x, z = _vectors(spark, rng, {0: 90, 5: 1, 7: 300, 9: 4}), _vectors(spark, rng, {0: 40, 5: 300, 7: 200, 8: 3})
    r_z = R.nbr_mean(z, x, 4, space="space")
    got = R.csls_topk(x, z, r_z, 3, space="space").collect()
    want = []
    for s in (0, 5, 7):
        one, other = x.where(F.col("space") == s).drop("space"), z.where(F.col("space") == s).drop("space")
        want += [(s, *r) for r in R.csls_topk(one, other, R.nbr_mean(other, one, 4), 3).collect()]
    assert sorted((r.space, r.src_idx, r["rank"], r.trg_idx) for r in got) == sorted((s, a, b, c) for s, a, b, c, _ in want)
    assert {r.space for r in got} == {0, 5, 7}                  # spaces without the other side have no rows
    assert knn.space_counts(x, z, "space") == {0: (90, 40), 5: (1, 300), 7: (300, 200)}
    many = knn.choose_blocks({s: (1000, 1000) for s in range(100)}, 8)
    assert set(many.values()) == {knn.choose_block(1000, 1000, 1)}       # many spaces need few blocks each


def test_floats_are_searched_as_doubles(spark):
    rng = np.random.default_rng(3)
    x = _vectors(spark, rng, {0: 80}).drop("space")
    small = x.withColumn("vec", F.col("vec").cast("array<float>"))
    wide = small.withColumn("vec", F.col("vec").cast("array<double>"))
    assert R.nn_topk(small, small, 4).collect() == R.nn_topk(wide, wide, 4).collect()


def test_keyed_grams_and_maps(spark):
    rng = np.random.default_rng(1)
    x = _vectors(spark, rng, {i: 3 + i % 5 for i in range(150)})
    got = {}
    for r in G.keyed_gram_rows(x, "space").collect():
        got.setdefault(r.space, {})[r.i] = r.row
    vecs, maps = {}, {}
    for r in x.collect():
        vecs.setdefault(r.space, []).append((r.idx, r.vec))
    for s, rows in vecs.items():
        m = np.array([v for _, v in rows])
        assert np.allclose([got[s][i] for i in range(5)], m.T @ m)
        maps[s] = rng.normal(size=(5, 3))
    table = spark.createDataFrame([(s, i, row.tolist()) for s, m in maps.items() for i, row in enumerate(m) if s != 4],
                                  "space bigint, i int, row array<double>")
    counts = {s: len(v) for s, v in vecs.items()}
    out = M.apply_keyed(x, table, counts, 5, unit=True).collect()
    assert len(out) == sum(n for s, n in counts.items() if s != 4)
    for r in out:
        y = np.array(dict(vecs[r.space])[r.idx]) @ maps[r.space]
        assert np.allclose(r.vec, y / np.linalg.norm(y)) and r.word == f"w{r.idx}"


def test_evaluation_of_pairs_is_that_of_each(spark):
    langs, pairs, words = registry._keyed_inputs(spark, SF0001)
    unit = N.unit(langs)
    src, trg = SP.pair_sides(unit, pairs)
    test = words.where("part = 'test'")
    empty = spark.createDataFrame([(77, "no", "word")], "space bigint, src_word string, trg_word string")
    got = {r.space: tuple(r)[1:] for r in SP.evaluate(src, trg, test.drop("part").unionByName(empty)).collect()}
    for p in pairs.collect():
        a, b = (unit.where(F.col("lang") == x).drop("lang") for x in (p.src_lang, p.trg_lang))
        want = BL.evaluate(a, b, test.where(F.col("space") == p.space).drop("space"), a, b).first()
        assert got[p.space] == pytest.approx(tuple(want[c] for c in SP.METRICS))
    assert got[77] == (0, 1, 0.0, 0, None, None, None)


def test_grid_is_the_single_fits(spark):
    langs, pairs, words = registry._keyed_inputs(spark, SF0001)
    two = pairs.where("space < 2")
    train, test = words.where("part = 'train'"), words.where("part = 'test'")
    rows = grid.grid(langs, pairs, train.where("space < 2"), test, lambdas=(0.1, 10.0), ranks=(None, 8)).collect()
    assert len(rows) == 2 * 4 and max(r.residual for r in rows if r.map_rank > 8) < 1e-9
    for p in two.collect():
        mine = sorted((r for r in rows if (r.src_lang, r.trg_lang) == (p.src_lang, p.trg_lang)), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4] and all(a.acc1 >= b.acc1 for a, b in zip(mine, mine[1:]))
        a, b = (langs.where(F.col("lang") == x).drop("lang") for x in (p.src_lang, p.trg_lang))
        for r in mine:
            if r.map_rank > 8:
                one = BL.run(a, b, train.where(F.col("space") == p.space), test.where(F.col("space") == p.space), lam=r["lambda"]).first()
                assert (r.acc1, r.acc10, r.n_covered) == (one.acc1, one.acc10, one.n_covered)
            else:
                full = next(x for x in mine if x.map_rank > 8 and x["lambda"] == r["lambda"])
                assert r.map_rank == 8 and r.cost > full.cost


def test_limited_rank_beats_truncation(spark):
    rng = np.random.default_rng(2)
    X, Z = rng.normal(size=(60, 7)) * np.arange(1, 8), rng.normal(size=(60, 9)) * np.arange(1, 10)[::-1]
    c = X.T @ Z
    for lam in (0.5, 50.0):
        path = FT.RidgePath(X.T @ X, Z.T @ Z, c)
        full = path.solve(lam / 2)
        costs = []
        for r in range(1, 8):
            w = path.solve(lam / 2, r)
            assert np.linalg.matrix_rank(w, tol=1e-9) <= r
            u, s, v = FT.factor(full, r)
            costs.append(path.objective(w, lam))
            assert costs[-1] <= path.objective(u @ np.diag(s) @ v.T, lam) + 1e-9
            if r < 7:           # stationary: no step of the factors lowers the cost
                a, d, b = FT.factor(w, r)
                grad = 2 * (X.T @ X @ w @ Z.T @ Z - c) + lam * w
                assert np.abs(a.T @ grad).max() < 1e-3 * np.abs(c).max() and np.abs(grad @ b).max() < 1e-3 * np.abs(c).max()
        assert all(x >= y - 1e-9 for x, y in zip(costs, costs[1:])) and np.isclose(costs[-1], path.objective(full, lam))
        m = FT.bilingual_fit(X.T @ X, Z.T @ Z, c, lam, rank=3)
        assert m.U["src"].shape == (7, 3) and m.U["trg"].shape == (9, 3) and m.B.shape == (3, 3)
    # without a ridge the weights are a product, and the optimum is a truncated SVD in whitened coordinates
    path = FT.RidgePath(X.T @ X, Z.T @ Z, c)
    lx, lz = np.linalg.cholesky(X.T @ X), np.linalg.cholesky(Z.T @ Z)
    u, s, vt = np.linalg.svd(np.linalg.solve(lx, np.linalg.solve(lz, c.T).T))
    best = np.linalg.solve(lx.T, (u[:, :2] * s[:2]) @ vt[:2]) @ np.linalg.inv(lz)
    assert np.isclose(path.objective(path.solve(0.0, 2), 0.0), path.objective(best, 0.0))


def test_rank_is_passed_through_every_fit(spark):
    langs, pairs, words = registry._keyed_inputs(spark, SF0001)
    s, t = (langs.where(F.col("lang") == x).drop("lang") for x in "st")
    train = words.where("space = 0 and part = 'train'")
    for semi in (False, True):
        f = BL.fit(s, t, train, 1.0, semi=semi, rank=6)
        assert f.model.B.shape == (6, 6)
        f.release()
    enc = D.encode(train, s, t)
    assert BL.fit_pairs(s, t, enc, 1.0, rank=5).U["trg"].shape[1] == 5
