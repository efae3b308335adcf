"""Self-training: grams by deltas, state in a table, going on where it stopped."""

import numpy as np
import pytest

from lexalign.operators import gram as G
from lexalign.plans import bilingual as BL
from lexalign.plans import semi
from lexalign.sources import fixtures as FX
from lexalign.sources.sinks import children
from tests.conftest import SF0001


def _inputs(spark):
    s, t, d = FX.lang_s(spark, SF0001), FX.lang_t_easy(spark, SF0001), FX.dictionary_seed(spark, SF0001)
    full = d.where("part = 'train'")
    return s, t, full, full.where("ord % 500 <> 0"), d.where("part = 'val'"), d.where("part = 'test'")


def test_deltas_equal_a_full_refit(spark):
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "idx bigint, vec array<double>")
    z = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)], "idx bigint, vec array<double>")
    grams = G.PairGrams(x, z)
    for n in (40, 41, 0, 25):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (n, 2))] * 2
        df = spark.createDataFrame(pairs + [(None, 3)], "src_idx bigint, trg_idx bigint")
        grams.update(df)
        assert grams.n_pairs == len(pairs)
        if pairs:
            full = BL.training_grams(x, z, df.dropna(), weighted=True)
            assert all(np.abs(grams.matrices[k] - full[k]).max() < 1e-9 for k in full)
        else:
            assert all(np.abs(m).max() < 1e-9 for m in grams.matrices.values())
    again = spark.createDataFrame(pairs + [(7, 7)], "src_idx bigint, trg_idx bigint")
    grams.update(again)
    assert grams.moved <= 1                    # only the pair that came


def same(rows, others):
    """Equal up to the order of floating-point sums."""
    assert [r[:3] for r in rows] == [r[:3] for r in others]
    for a, b in zip(rows, others):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x for x in a[3:] if x is not None] == pytest.approx([x for x in b[3:] if x is not None], abs=1e-9)


def test_a_killed_loop_goes_on(spark, tmp_path):
    inputs = _inputs(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    whole = [tuple(r) for r in semi.bootstrap(*inputs, patience=2).collect()]
    assert len(whole) >= 4 and spark.sparkContext._jsc.getPersistentRDDs().size() == before

    class Killed(Exception):
        pass

    seen = []

    def kill(n):
        seen.append(n)
        if len(seen) in (1, 3):
            raise Killed
    for _ in range(2):
        with pytest.raises(Killed):
            semi.bootstrap(*inputs, patience=2, state_path=str(tmp_path / "state"), after_round=kill)
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    # a round that was cut off while it wrote is not taken for finished
    torn = tmp_path / "state" / f"round-{len(seen):04d}"
    torn.mkdir()
    got = [tuple(r) for r in semi.bootstrap(*inputs, patience=2, state_path=str(tmp_path / "state"), after_round=seen.append).collect()]
    assert seen == list(range(len(whole) - 1))                 # every round ran once
    same(got, whole)
    assert len([n for n in children(spark, str(tmp_path / "state")) if n.startswith("round-")]) == len(whole) - 1
    done = [tuple(r) for r in semi.bootstrap(*inputs, patience=2, state_path=str(tmp_path / "state"), after_round=seen.append).collect()]
    same(done, got)
    assert len(seen) == len(whole) - 1          # nothing is left to do but the final fit
