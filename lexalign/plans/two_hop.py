"""Two-hop (pivot) translation: source -> mid -> target.

* ``fit``: two independent bilingual fits (source–mid and mid–target).
* ``composition_eval`` (CMP): source vectors mapped by ``W₁₂·W₂₃`` and
  retrieved by CSLS against the raw target vectors.
* ``pipeline_eval`` (PIP): CSLS top-1 source -> mid in the first latent space,
  then CSLS top-10 mid -> target in the second one, keyed by the source word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import mapping as M
from lexalign.operators import metrics as S
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.operators.fit import Model
from lexalign.plans import bilingual as BL
from lexalign.session import materialise


def fit(x: DataFrame, y: DataFrame, z: DataFrame, train_xy: DataFrame, train_yz: DataFrame,
        lam: float = 10.0, normalize=("unit", "center"), rank: int | None = None):
    """Two independent fits; returns ``(fit_xy, fit_yz)`` with languages s/m and m/t, to be released."""
    f1 = BL.fit(x, y, train_xy, lam, normalize, src="s", trg="m", rank=rank)
    f2 = BL.fit(y, z, train_yz, lam, normalize, src="m", trg="t", rank=rank)
    return f1, f2


def _score(xw: DataFrame, zw: DataFrame, test: DataFrame, src_emb: DataFrame, trg_emb: DataFrame,
           csls_k: int = 10) -> DataFrame:
    enc = D.encode(test, src_emb, trg_emb)
    gold = D.gold(enc)
    cands = BL.retrieve(xw, zw, gold, "csls", 10, csls_k)
    return S.evaluation_row(D.coverage(test, src_emb, trg_emb), S.precision_at_k(cands, gold))


def composition_eval(x: DataFrame, z: DataFrame, test: DataFrame, w12: np.ndarray, w23: np.ndarray,
                     csls_k: int = 10, x_raw: DataFrame | None = None,
                     z_raw: DataFrame | None = None) -> DataFrame:
    """CMP metrics row.  ``x``/``z`` are the (normalised) tables; raw ones give the word index."""
    xw = materialise(N.unit(M.apply_matrix(x, M.compose(w12, w23))), "mapped")
    zw = materialise(N.unit(z), "unit")
    return _score(xw, zw, test, x_raw if x_raw is not None else x, z_raw if z_raw is not None else z, csls_k)


def pipeline_eval(x: DataFrame, y: DataFrame, z: DataFrame, test: DataFrame, m1: Model, m2: Model,
                  csls_k: int = 10, langs=("s", "m", "t"),
                  raw: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """PIP metrics row (the reference's two CSLS stages)."""
    ls, lm, lt = langs
    xr, yr, zr = raw if raw is not None else (x, y, z)
    enc = D.encode(test, xr, zr)
    gold = D.gold(enc)
    # stage 1: source -> mid, best by CSLS
    x1 = materialise(N.unit(M.to_latent(x, m1, ls)), "mapped")
    y1 = materialise(N.unit(M.to_latent(y, m1, lm)), "mapped")
    q1 = x1.join(gold.select(F.col("src_idx").alias("idx")).distinct(), "idx", "left_semi")
    rz1 = R.nbr_mean(y1, x1, csls_k)
    mid = materialise(R.csls_topk(q1, y1, rz1, 1).select("src_idx", F.col("trg_idx").alias("mid_idx")), "middle-words")
    # stage 2: mid -> target, top-10 by CSLS for the distinct mids
    y2 = materialise(N.unit(M.to_latent(y, m2, lm)), "mapped")
    z2 = materialise(N.unit(M.to_latent(z, m2, lt)), "mapped")
    q2 = y2.join(mid.select(F.col("mid_idx").alias("idx")).distinct(), "idx", "left_semi")
    rz2 = R.nbr_mean(z2, y2, csls_k)
    c2 = R.csls_topk(q2, z2, rz2, 10).withColumnRenamed("src_idx", "mid_idx")
    cands = mid.join(c2, "mid_idx").select("src_idx", "rank", "trg_idx", "score")
    return S.evaluation_row(D.coverage(test, xr, zr), S.precision_at_k(cands, gold))
