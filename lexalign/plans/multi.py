"""Multilingual job: one map per language and one shared ``B`` fitted on several pairs.

Spark computes, per training pair, the grams over distinct rows and the
in-vocabulary pair count (all pairs' grams in one job); the driver runs the
shared-``B`` descent on those ``d x d`` matrices (``fit.multi_fit``), started
from the pairwise closed forms.  Evaluation maps every language once and
scores all test dictionaries of the manifest in one job (``plans.spaces``), one
metrics row per pair.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import gram as G
from lexalign.operators import mapping as M
from lexalign.operators import normalize as N
from lexalign.operators.fit import Model, init_from_pairs, multi_fit
from lexalign.plans import spaces as SP
from lexalign.session import materialise


def fit(langs: dict[str, DataFrame], train: list[tuple[str, str, DataFrame]], lam: float = 10.0,
        normalize=("unit", "center"), max_iter: int = 300, **limits) -> tuple[Model, dict[str, DataFrame]]:
    norm = {k: N.normalize(v, normalize).persist(StorageLevel.MEMORY_AND_DISK) for k, v in langs.items()}
    specs, counts = {}, {}
    for p, (a, b, d) in enumerate(train):
        enc = D.encode(d, langs[a], langs[b])
        src_ids, trg_ids = D.distinct_rows(enc)
        xs = norm[a].join(src_ids.withColumnRenamed("src_idx", "idx"), "idx", "left_semi")
        zs = norm[b].join(trg_ids.withColumnRenamed("trg_idx", "idx"), "idx", "left_semi")
        e = D.edges(enc)
        pairs = (e.join(norm[a].select(F.col("idx").alias("src_idx"), F.col("vec").alias("xv")), "src_idx")
                  .join(norm[b].select(F.col("idx").alias("trg_idx"), F.col("vec").alias("zv")), "trg_idx"))
        specs[f"{p}:sxx"] = (xs, "vec", None, None)
        specs[f"{p}:szz"] = (zs, "vec", None, None)
        specs[f"{p}:c"] = (pairs, "xv", "zv", None)
        counts[p] = enc.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_idx", "trg_idx").alias("a2"))
    g = G.grams(specs)
    pair_stats = []
    for p, (a, b, _) in enumerate(train):
        cnt = counts[p].first()
        pair_stats.append({"src": a, "trg": b, "sxx": g[f"{p}:sxx"], "szz": g[f"{p}:szz"], "c": g[f"{p}:c"],
                           "n": float(cnt["n"]), "a2": float(cnt["a2"])})
    init = init_from_pairs(pair_stats, list(langs), lam)
    model = multi_fit(pair_stats, lam, init, max_iter=max_iter, **limits)
    return model, norm


def mapped_languages(model: Model, norm: dict[str, DataFrame], normalize_eval: bool = True) -> DataFrame:
    """``(lang, idx, word, vec)``: every language in the shared space, written once."""
    out = None
    for lang, df in norm.items():
        one = M.to_latent(df.select("idx", "word", "vec"), model, lang)
        one = (N.unit(one) if normalize_eval else one).select(F.lit(lang).alias("lang"), "idx", "word", "vec")
        out = one if out is None else out.unionByName(one)
    return materialise(out, "mapped")


def evaluate_pairs(mapped: DataFrame, tests: list[tuple[str, str, DataFrame]], method: str = "csls",
                   csls_k: int = 10) -> DataFrame:
    """One metrics row per test pair: ``(src_lang, trg_lang, n_covered, …, acc10)``, from :func:`mapped_languages`."""
    spark = mapped.sparkSession
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(tests)], "space bigint, src_lang string, trg_lang string")
    words = None
    for i, (_, _, d) in enumerate(tests):
        one = d.select(F.lit(i).cast("bigint").alias("space"), "src_word", "trg_word")
        words = one if words is None else words.unionByName(one)
    return score_pairs(mapped, pairs, words, method, csls_k)


def score_pairs(mapped: DataFrame, pairs: DataFrame, tests: DataFrame, method: str = "csls", csls_k: int = 10) -> DataFrame:
    """Metrics of ``pairs(space, src_lang, trg_lang)`` on ``tests(space, src_word, trg_word)``, all in one job."""
    src, trg = SP.pair_sides(mapped, pairs)
    return pairs.join(SP.evaluate(src, trg, tests, method, csls_k), "space", "left").drop("space")
