"""The block product's kernel against all scores in double, its work and its memory."""

import numpy as np
import pytest

from lexalign.operators import knn
from lexalign.operators import retrieval as R
from lexalign.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def case(name, rng, n=700, m=1500, d=16):
    x, y, yb = rng.normal(size=(n, d)), rng.normal(size=(m, d)), np.zeros(m)
    if name == "copies":                                      # groups of equal rows, larger than k, and zero vectors
        x, y = x[rng.integers(0, 30, n)], y[rng.integers(0, 40, m)]
        x[::7], y[::5] = 0.0, 0.0
    elif name == "near ties":                                 # apart by less than single precision tells
        y = y[0] + 1e-9 * y
    elif name == "long and short":
        x, y, yb = x * 10.0 ** rng.integers(-9, 9, (n, 1)), y * 10.0 ** rng.integers(-9, 9, (m, 1)), rng.normal(size=m)
    elif name == "biased":
        yb = np.round(rng.normal(size=m), 1)
    return x, rng.normal(size=n), y, yb


@pytest.mark.parametrize("name", ["plain", "copies", "near ties", "long and short", "biased"])
@pytest.mark.parametrize("k", [1, 10, 60])
def test_rows_topk_finds_what_all_scores_in_double_give(name, k, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 64)
    monkeypatch.setattr(knn, "COLUMNS", 400)
    x, xb, y, yb = case(name, np.random.default_rng(3))
    ids = np.arange(len(y)) * 3 + 1
    row, other, score = knn._rows_topk(x, xb, y, yb, ids, k, 2.0)
    exact = 2.0 * np.einsum("id,jd->ij", x, y) + xb[:, None] + yb[None, :]
    assert sorted(zip(row.tolist(), other.tolist())) == sorted(set(zip(row.tolist(), other.tolist()))) and len(row) == k * len(x)
    assert np.allclose(score, exact[row, (other - 1) // 3], rtol=1e-12, atol=1e-12 * np.abs(exact).max())
    want = -np.sort(-exact, axis=1)[:, :k]
    got = score[np.lexsort((-score, row))].reshape(-1, k)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12 * np.abs(exact).max())
    if name == "copies":                                      # ties go to the lower id
        zero = other[row == 0]
        assert (yb == 0).all() and zero.tolist() == ids[:k].tolist()


def test_numbers_beyond_single_precision_are_scored_in_double():
    assert knn._fits_single(np.array([1e14]), np.zeros(3)) and not knn._fits_single(np.array([1e30]))
    assert not knn._fits_single(np.array([1.0, np.nan])) and not knn._fits_single(np.array([-np.inf]))


def test_blocks_stay_small_at_any_number_of_rows():
    for dim in (64, 300):
        assert knn.choose_block(10**7, 10**7, 8, dim) * 8 * dim <= 1 << 25


def test_each_score_is_computed_once(spark, monkeypatch):
    """Neighbourhoods are not computed anew where what they are joined with is counted."""
    scores = spark.sparkContext.accumulator(0)
    make = knn._kernel_factory

    def counted(*args):
        kernel = make(*args)

        def run(group, left, right):
            scores.add(left.num_rows * right.num_rows)
            return kernel(group, left, right)
        return run
    monkeypatch.setattr(knn, "_kernel_factory", counted)
    s, t = FX.lang_s(spark, SF), FX.lang_t(spark, SF)
    queries = s.where("idx % 5 = 4")
    n, q = s.count(), queries.count()
    assert len(R.csls_topk(queries, t, R.nbr_mean(t, s, 10), 10).collect()) == 10 * q
    assert scores.value == n * n + q * n


@pytest.mark.parametrize("biased", [False, True])
def test_few_pairs_are_scored_in_double(biased, monkeypatch):
    """About k of a row's pairs are scored again, however many tiles the rows of the other side fill."""
    scored, make = [], knn._score

    def counted(x, xb, y, yb, i, j, alpha):
        scored.append(len(i))
        return make(x, xb, y, yb, i, j, alpha)
    monkeypatch.setattr(knn, "_score", counted)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(600, 32)), rng.normal(size=(20_000, 32))
    knn._rows_topk(x, np.zeros(600), y, rng.normal(size=20_000) * biased, np.arange(20_000), 10, 1.0)
    assert sum(scored) <= 1.2 * 10 * 600


@pytest.mark.parametrize("held", [200, 5000])
def test_pairs_held_are_bounded(held, monkeypatch):
    """Rows whose scores differ by less than the rounding: what is held is scored in double, ties go to the lower id."""
    monkeypatch.setattr(knn, "HELD", held)
    monkeypatch.setattr(knn, "ROWS", 8)
    monkeypatch.setattr(knn, "COLUMNS", 64)
    most, add = [0], knn._Near.add

    def watched(near, *pairs):
        add(near, *pairs)
        most[0] = max(most[0], near.held)
    monkeypatch.setattr(knn._Near, "add", watched)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(20, 8)), 1.0 + 1e-12 * rng.integers(0, 5, (4000, 8))
    row, other, score = knn._rows_topk(x, np.zeros(20), y, np.zeros(4000), np.arange(4000) * 2, 5, 1.0)
    exact = np.einsum("id,jd->ij", x, y)
    for i in range(20):
        best = np.lexsort((np.arange(4000), -exact[i]))[:5]
        assert np.allclose(np.sort(score[row == i]), np.sort(exact[i, best]), rtol=0, atol=1e-14 * np.abs(x[i]).sum())
    assert most[0] <= max(held, 4 * 8 * 5)


def test_kth_and_set_places():
    rng = np.random.default_rng(7)
    row = rng.integers(0, 6, 300) * 2
    value = np.round(rng.normal(size=300), 1).astype(np.float32)
    value[:5] = -0.0, 0.0, -np.inf, np.inf, -1e30
    want = [np.sort(value[row == r])[-4] if (row == r).sum() >= 4 else -np.inf for r in range(13)]
    assert knn._kth(row, value, 13, 4).tolist() == [float(w) for w in want]
    flags = rng.random(8000) < 0.01
    assert knn._set(flags).tolist() == np.flatnonzero(flags).tolist()


def test_fixed_spaces_and_unit_vectors_are_written_once(spark):
    """Searches count, measure and read what they are given: it must not be mapped or joined anew each time."""
    from lexalign.plans import registry
    for df in (*registry._unit_st(spark, SF)[:2], *registry._fixed_spaces(spark, SF)[:2]):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" not in plan and len(df.inputFiles()) > 0


@pytest.mark.parametrize("name", ["plain", "copies", "near ties", "long and short", "biased"])
@pytest.mark.parametrize("k", [1, 10])
def test_both_sides_come_from_one_product(name, k, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 64)
    monkeypatch.setattr(knn, "COLUMNS", 400)
    x, xb, y, yb = case(name, np.random.default_rng(4))
    if name == "copies":                                      # few of them, or each side is searched by itself
        x, y = x + np.arange(len(x))[:, None] % 200, y + np.arange(len(y))[:, None] % 500
    xid, yid = np.arange(len(x)) * 2 + 5, np.arange(len(y)) * 3 + 1
    searched, make = [], knn._search

    def counted(*args, **kw):
        searched.append(1)
        return make(*args, **kw)
    monkeypatch.setattr(knn, "_search", counted)
    both = knn._both_topk(x, xb, xid, y, yb, yid, k, 2.0)
    assert len(searched) == 1
    for found, alone in zip(both, (knn._rows_topk(x, xb, y, yb, yid, k, 2.0), knn._rows_topk(y, yb, x, xb, xid, k, 2.0))):
        rows = [sorted(zip(*(c.tolist() for c in t))) for t in (found, alone)]
        assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]]
        assert np.allclose([r[2] for r in rows[0]], [r[2] for r in rows[1]], rtol=1e-12, atol=0)


@pytest.mark.parametrize("m", [1, 15, 16, 17, 399, 400, 401, 1007])
@pytest.mark.parametrize("columns", [8, 100, 400])
def test_groups_of_right_rows_that_do_not_come_out_even(m, columns, monkeypatch):
    """The last group of a tile is filled up: no right row is found twice and none is left out, whatever the tile."""
    monkeypatch.setattr(knn, "ROWS", 32)
    monkeypatch.setattr(knn, "COLUMNS", columns)
    rng = np.random.default_rng(8)
    x, xb, y, yb = rng.normal(size=(70, 8)), rng.normal(size=70), rng.normal(size=(m, 8)), rng.normal(size=m)
    x[:5], yb[-1] = 10 * y[-1], 100.0                         # the row that the filling repeats is everyone's best
    k = min(10, m)
    exact = 2.0 * np.einsum("id,jd->ij", x, y) + xb[:, None] + yb[None, :]
    row, other, score = knn._rows_topk(x, xb, y, yb, np.arange(m) * 3, k, 2.0)
    order = np.lexsort((-score, row))
    assert (other[order].reshape(-1, k) // 3).tolist() == np.argsort(-exact, axis=1, kind="stable")[:, :k].tolist()
    found = knn._search(x, xb, y, yb, min(k, 3), 2.0, back=True)[1]
    assert sorted(zip(found[0].tolist(), found[1].tolist())) == \
        sorted((j, int(i)) for j in range(m) for i in np.argsort(-exact[:, j], kind="stable")[:min(k, 3)])


def test_large_parts_of_a_tile_are_not_searched_for_pairs(monkeypatch):
    """Scores are looked at one by one in few groups only: those whose largest one may matter."""
    looked, real = [], np.nonzero

    def counted(a):
        looked.append(a.size)
        return real(a)
    monkeypatch.setattr(knn.np, "nonzero", counted)
    monkeypatch.setattr(knn, "_set", lambda flags: pytest.fail("a whole tile is searched"))
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(600, 32)), rng.normal(size=(20_000, 32))
    knn._rows_topk(x, np.zeros(600), y, np.zeros(20_000), np.arange(20_000), 10, 1.0)
    assert 0 < sum(looked) <= 0.2 * 600 * 20_000


@pytest.mark.parametrize("name", ["plain", "copies", "near ties", "long and short", "biased"])
@pytest.mark.parametrize("share", [0.002, 0.2, 0.9])
def test_few_rows_of_a_side_come_from_the_product_of_the_other(name, share, monkeypatch):
    """Rows of one side that are asked for, and all of the other, from one product; ties go to the lower id."""
    monkeypatch.setattr(knn, "ROWS", 64)
    monkeypatch.setattr(knn, "COLUMNS", 400)
    rng = np.random.default_rng(5)
    x, xb, y, yb = case(name, rng)
    if name == "copies":
        x, y = x + np.arange(len(x))[:, None] % 200, y + np.arange(len(y))[:, None] % 500
    xid, yid = np.arange(len(x)) * 2 + 5, np.arange(len(y)) * 3 + 1
    wanted = rng.random(len(y)) < share
    wanted[7] = True
    searched, make = [], knn._search

    def counted(*args, **kw):
        searched.append(1)
        return make(*args, **kw)
    monkeypatch.setattr(knn, "_search", counted)
    both = knn._both_topk(x, xb, xid, y, yb, yid, 10, 2.0, wanted=wanted)
    assert len(searched) == 1
    for found, alone in zip(both, (knn._rows_topk(x, xb, y, yb, yid, 10, 2.0), knn._rows_topk(y[wanted], yb[wanted], x, xb, xid, 10, 2.0))):
        rows = [sorted(zip(*(c.tolist() for c in t))) for t in (found, alone)]
        assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]]
        assert np.allclose([r[2] for r in rows[0]], [r[2] for r in rows[1]], rtol=1e-12, atol=0)


def test_means_of_test_words_and_targets_come_from_one_product(spark, monkeypatch):
    """``csls_top1``: the whole product gives both means; beside it only the test words are searched."""
    from lexalign.plans import registry
    scores = spark.sparkContext.accumulator(0)
    make = knn._kernel_factory

    def counted(*args):
        kernel = make(*args)

        def run(group, left, right):
            scores.add(left.num_rows * right.num_rows)
            return kernel(group, left, right)
        return run
    monkeypatch.setattr(knn, "_kernel_factory", counted)
    n = FX.lang_s(spark, SF).count()
    q = len(registry.csls_top1(spark, SF).collect())
    assert 0 < q < n and scores.value == n * n + q * n


def test_written_queries_are_not_joined_anew(spark):
    """The searched test words of ``csls_top1`` and ``candidate_lines`` are written once."""
    from lexalign.plans import bilingual, registry
    xu, zu, d, s, t = registry._unit_st(spark, SF)
    q, gold = registry._test_queries(xu, s, t, d)
    assert "Join" not in q._jdf.queryExecution().optimizedPlan().toString() and q.count() > 0
    plain, with_rx = (bilingual.retrieve(xu, zu, gold, "csls", 3, 10, with_rx=w).collect() for w in (False, True))
    assert sorted(r[:3] for r in plain) == sorted(r[:3] for r in with_rx) and len(plain) == 3 * q.count()
