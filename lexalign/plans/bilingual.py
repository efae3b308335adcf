"""Bilingual job: normalise -> encode -> grams -> closed-form fit -> map -> retrieve -> score.

Spark does the data work (normalisation, dictionary joins, gram aggregates,
mapping of whole vocabularies, block top-k retrieval, metric aggregates); the
driver solves one ``d x d`` problem.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import gram as G
from lexalign.operators import mapping as M
from lexalign.operators import metrics as S
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.operators.fit import Model, bilingual_fit, residual
from lexalign.session import materialise


@dataclass
class Fitted:
    model: Model
    x: DataFrame      # normalised source table (idx, word, vec)
    z: DataFrame      # normalised target table
    n_pairs: int | None = None

    def release(self) -> None:
        """Give the cached tables back."""
        self.x.unpersist()
        self.z.unpersist()


def _dim(df: DataFrame, vec: str = "vec") -> int:
    return int(df.select(F.size(vec)).first()[0])


def training_grams(x: DataFrame, z: DataFrame, enc: DataFrame, weighted: bool = False) -> dict:
    """``sxx`` over distinct source rows, ``szz`` over distinct target rows,
    ``c`` = Σ over (binary or weighted) edges of ``x zᵀ``."""
    src_ids, trg_ids = D.distinct_rows(enc)
    xs = x.join(src_ids.withColumnRenamed("src_idx", "idx"), "idx", "left_semi")
    zs = z.join(trg_ids.withColumnRenamed("trg_idx", "idx"), "idx", "left_semi")
    e = D.weighted_edges(enc) if weighted else D.edges(enc).withColumn("weight", F.lit(1))
    pairs = (e.join(x.select(F.col("idx").alias("src_idx"), F.col("vec").alias("xv")), "src_idx")
              .join(z.select(F.col("idx").alias("trg_idx"), F.col("vec").alias("zv")), "trg_idx"))
    specs = {"sxx": (xs, "vec", None, None), "szz": (zs, "vec", None, None),
             "c": (pairs, "xv", "zv", "weight" if weighted else None)}
    return G.grams(specs)


def fit_pairs(xn: DataFrame, zn: DataFrame, enc: DataFrame, lam: float, src: str = "src",
              trg: str = "trg", semi: bool = False, rank: int | None = None) -> Model:
    """Closed-form fit from already normalised tables and encoded pairs ``(src_idx, trg_idx)``."""
    g = training_grams(xn, zn, enc, weighted=semi)
    n_pairs = enc.count() if semi else None
    if g["sxx"].size and g["szz"].size and g["c"].size:
        sxx, szz, c = g["sxx"], g["szz"], g["c"]
    else:  # empty training dictionary: the zero map
        dx, dz = _dim(xn), _dim(zn)
        sxx, szz, c = np.zeros((dx, dx)), np.zeros((dz, dz)), np.zeros((dx, dz))
    model = bilingual_fit(sxx, szz, c, lam, src, trg, n_pairs=n_pairs, rank=rank)
    model.info |= {"n_pairs": n_pairs, "residual": residual(sxx, szz, c, model.cross_map(src, trg), lam, n_pairs)}
    return model


def fit(x: DataFrame, z: DataFrame, train: DataFrame, lam: float = 100.0,
        normalize: Sequence[str] = ("unit", "center"), fold_case: bool = False,
        src: str = "src", trg: str = "trg", semi: bool = False, rank: int | None = None) -> Fitted:
    """Fit the model on a training dictionary (``semi=True``: self-training objective); ``release`` the result's caches."""
    xn = N.normalize(x, normalize).persist(StorageLevel.MEMORY_AND_DISK)
    zn = N.normalize(z, normalize).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_pairs(xn, zn, D.encode(train, x, z, fold_case), lam, src, trg, semi, rank)
    return Fitted(model, xn, zn, model.info["n_pairs"])


def mapped(fitted: Fitted, src: str = "src", trg: str = "trg",
           normalize_eval: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both vocabularies in the latent space (unit length when ``normalize_eval``)."""
    xw = M.to_latent(fitted.x, fitted.model, src)
    zw = M.to_latent(fitted.z, fitted.model, trg)
    if normalize_eval:
        xw, zw = N.unit(xw), N.unit(zw)
    return xw, zw


def retrieve(xw: DataFrame, zw: DataFrame, gold: DataFrame, method: str = "csls",
             k: int = 10, csls_k: int = 10, with_rx: bool = False,
             r_z: DataFrame | None = None) -> DataFrame:
    """Top-k candidates ``(src_idx, rank, trg_idx, score)`` for every gold source row.

    ``r_z`` (target neighbourhoods against the whole source) may be given if it is
    known for these spaces; ``r_x`` is only computed where the score is asked for. The queries are
    written once, as searches count and read them.
    """
    queries = materialise(xw.join(gold.select(F.col("src_idx").alias("idx")).distinct(), "idx", "left_semi"), "queries")
    if method not in ("nn", "csls"):
        raise ValueError("method must be 'nn' or 'csls'")
    if method == "nn":
        return R.nn_topk(queries, zw, k)
    r_x = None
    if r_z is None and with_rx:
        r_x, r_z = R.neighbourhood(xw, zw, csls_k, queries)
    elif r_z is None:
        r_z = R.nbr_mean(zw, xw, csls_k)
    elif with_rx:
        r_x = R.nbr_mean(queries, zw, csls_k)
    return R.csls_topk(queries, zw, r_z, k, r_x=r_x)


def evaluate(xw: DataFrame, zw: DataFrame, test: DataFrame, src_emb: DataFrame,
             trg_emb: DataFrame, method: str = "csls", csls_k: int = 10,
             fold_case: bool = False, r_z: DataFrame | None = None) -> DataFrame:
    """Coverage and precision@1/5/10 of a test dictionary: one metrics row.

    ``xw`` and ``zw`` are read several times: pass tables that are written or cached.
    """
    enc = D.encode(test, src_emb, trg_emb, fold_case)
    gold = D.gold(enc)
    cands = retrieve(xw, zw, gold, method, 10, csls_k, r_z=r_z)
    acc = S.precision_at_k(cands, gold)
    cov = D.coverage(test, src_emb, trg_emb, fold_case)
    return S.evaluation_row(cov, acc)


def run(x: DataFrame, z: DataFrame, train: DataFrame, test: DataFrame, lam: float = 100.0,
        normalize: Sequence[str] = ("unit", "center"), method: str = "csls",
        csls_k: int = 10, fold_case: bool = False, normalize_eval: bool = True, rank: int | None = None) -> DataFrame:
    """Entry 1 of the reference: train on ``train``, report metrics on ``test``."""
    fitted = fit(x, z, train, lam, normalize, fold_case, rank=rank)
    xw, zw = (materialise(df, "mapped") for df in mapped(fitted, normalize_eval=normalize_eval))
    fitted.release()
    return evaluate(xw, zw, test, x, z, method, csls_k, fold_case)
