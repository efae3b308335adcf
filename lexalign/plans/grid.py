"""Hyper-parameter grid: all language pairs times all λ (and ranks) in one job.

The grams of every pair are summed by key. A task a pair takes its eigenvectors once and
gives the closed form of every λ as rows of a table, so neither grams nor maps
reach the driver. Every pair is a space of ``plans.spaces``. The vectors stay as they are: the tasks that compare them
apply the maps of all models (``operators.bymodel``), and all models are evaluated together and ranked by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import gram as G
from lexalign.operators import mapping as M
from lexalign.operators import normalize as N
from lexalign.operators._arrow import list_to_matrix, matrix_to_list
from lexalign.operators.fit import RidgePath, factor, psd_sqrt
from lexalign.plans import spaces as SP
from lexalign.session import materialise

LAMBDAS = (1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3)
MODELS_SCHEMA = "pair bigint, model int, part string, i int, row array<double>"


def pair_grams(langs: DataFrame, pairs: DataFrame, train: DataFrame) -> DataFrame:
    """``(space, part, i, row)``: ``sxx`` and ``szz`` over distinct rows and ``c`` over distinct edges of every pair.

    ``langs(lang, idx, word, vec)``, ``pairs(space, src_lang, trg_lang)``, ``train(space, src_word, trg_word)``.
    """
    src, trg = SP.pair_sides(langs, pairs)
    edges = materialise(D.edges(D.encode(train, src, trg, keys=SP.KEY), SP.KEY), "edges")

    def taking_part(side: DataFrame, column: str) -> DataFrame:
        return side.join(edges.select("space", F.col(column).alias("idx")).distinct(), ["space", "idx"], "left_semi")
    joined = edges.join(src.select("space", F.col("idx").alias("src_idx"), F.col("vec").alias("xv")), ["space", "src_idx"]) \
        .join(trg.select("space", F.col("idx").alias("trg_idx"), F.col("vec").alias("zv")), ["space", "trg_idx"])
    parts = {"sxx": G.keyed_gram_rows(taking_part(src, "src_idx"), "space"),
             "szz": G.keyed_gram_rows(taking_part(trg, "trg_idx"), "space"),
             "c": G.keyed_gram_rows(joined, "space", "xv", "zv")}
    out = None
    for name, rows in parts.items():
        one = rows.select("space", F.lit(name).alias("part"), "i", "row")
        out = one if out is None else out.unionByName(one)
    return out


def fit_all(grams: DataFrame, lambdas: Sequence[float], ranks: Sequence[int | None] = (None,)) -> DataFrame:
    """Models ``(pair, model, part, i, row)`` of every pair, λ and rank; ``model`` counts ranks first, then λ.

    Parts: the latent maps ``src`` and ``trg``, the cross map ``w`` and ``info``: cost, largest entry of the residual and
    the rank. A group is the grams of one pair, ``2 d_x + d_z`` rows.
    """
    lambdas, ranks = [float(x) for x in lambdas], list(ranks)

    def fit(group: pa.Table) -> pa.Table:
        pair = group.column("space")[0].as_py()
        grams = {}
        for name in ("sxx", "szz", "c"):
            part = group.filter(pa.compute.equal(group.column("part"), name))
            grams[name] = list_to_matrix(part.column("row"))[np.argsort(part.column("i").to_numpy())]
        path = RidgePath(**grams)
        out = []
        for number, (rank, lam) in enumerate((r, x) for r in ranks for x in lambdas):
            w = path.solve(lam / 2.0, rank)
            u, s, v = factor(w, rank)
            half = psd_sqrt(np.diag(s))
            info = np.array([[path.objective(w, lam), path.residual(w, lam), float(len(s))]])
            for part, m in (("src", u @ half), ("trg", v @ half), ("w", w), ("info", info)):
                out.append(pa.table([pa.array(np.full(len(m), pair)), pa.array(np.full(len(m), number, dtype=np.int32)),
                                     pa.array([part] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), matrix_to_list(m)],
                                    names=["pair", "model", "part", "i", "row"]))
        return pa.concat_tables(out)

    return materialise(grams.groupBy("space").applyInArrow(fit, MODELS_SCHEMA), "models")


def model_infos(models: DataFrame, lambdas: Sequence[float], ranks: Sequence[int | None] = (None,)) -> DataFrame:
    """``(pair, model, lambda, cost, residual, rank_limit)``, a row a model."""
    numbers = [(i, float(x)) for i, (_, x) in enumerate((r, x) for r in ranks for x in lambdas)]
    named = models.sparkSession.createDataFrame(numbers, "model int, lambda double")
    return models.where("part = 'info'").join(F.broadcast(named), "model").select(
        "pair", "model", "lambda", F.col("row")[0].alias("cost"), F.col("row")[1].alias("residual"),
        F.col("row")[2].cast("int").alias("map_rank"))


def grid(langs: DataFrame, pairs: DataFrame, train: DataFrame, test: DataFrame, lambdas: Sequence[float] = LAMBDAS,
         ranks: Sequence[int | None] = (None,), normalize: Sequence[str] = ("unit", "center"), csls_k: int = 10) -> DataFrame:
    """One row a pair, λ and rank, the best ``acc1`` of each pair first (ties: the smaller λ, then rank).

    ``(src_lang, trg_lang, rank, lambda, map_rank, cost, residual, n_covered, …, acc10)``. A pair without a
    training pair in both vocabularies has no models and no rows.
    """
    spark = langs.sparkSession
    norm = materialise(N.normalize(langs, normalize, group_cols=["lang"]), "normalised")
    models = fit_all(pair_grams(norm, pairs, train), lambdas, ranks)
    infos = model_infos(models, lambdas, ranks)
    mapped = [M.apply_keyed(side, models.where(F.col("part") == part).select(F.col("pair").alias("space"), "model", "i", "row"), unit=True, late=True)
              for part, side in zip(("src", "trg"), SP.pair_sides(norm, pairs))]
    scored = infos.join(SP.evaluate(*mapped, test, "csls", csls_k).withColumnRenamed("space", "pair"), ["pair", "model"], "left")
    order = Window.partitionBy("pair").orderBy(F.col("acc1").desc_nulls_last(), "lambda", "map_rank")     # a row a model
    return scored.withColumn("rank", F.row_number().over(order)) \
        .join(F.broadcast(pairs.withColumnRenamed("space", "pair")), "pair") \
        .select("src_lang", "trg_lang", "rank", "lambda", "map_rank", "cost", "residual", *SP.METRICS)
