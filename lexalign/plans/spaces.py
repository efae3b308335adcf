"""Evaluation of many language pairs or models at once.

A *space* is one pair of vocabularies that were mapped to be compared: a test pair of a
manifest, or one model of a grid. All spaces are rows of the same tables, ``(space, idx,
word, vec)`` for sources and targets and ``(space, src_word, trg_word)`` for dictionaries,
so a job has one block product for all target neighbourhoods, one for all candidates, one
rank window and one metrics frame, however many spaces there are. Sides that many models map late
(``mapping.Mapped``) are evaluated under each model of their space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import metrics as S
from lexalign.operators import retrieval as R
from lexalign.operators.mapping import Mapped

KEY = ["space"]
METRICS = ("n_covered", "n_oov", "coverage", "n_queries", "acc1", "acc5", "acc10")


def pair_sides(langs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and targets ``(space, idx, word, vec)`` of ``pairs(space, src_lang, trg_lang)`` from ``(lang, idx, word, vec)``."""
    def side(column: str) -> DataFrame:
        wanted = pairs.select("space", F.col(column).alias("lang"))        # a row a pair
        return langs.join(F.broadcast(wanted), "lang").select("space", "idx", "word", "vec")
    return side("src_lang"), side("trg_lang")


def evaluate(src: DataFrame | Mapped, trg: DataFrame | Mapped, tests: DataFrame, method: str = "csls", csls_k: int = 10,
             fold_case: bool = False) -> DataFrame:
    """One metrics row a space of ``tests``: ``(space, n_covered, n_oov, coverage, n_queries, acc1, acc5, acc10)``.

    A space without a gold pair has null shares and no queries. Sides that are ``Mapped`` give a row a space and
    model, with the column ``model`` after ``space``; words and gold pairs are the same for all models and looked up once a space.
    """
    if method not in ("nn", "csls"):
        raise ValueError("method must be 'nn' or 'csls'")
    late = isinstance(src, Mapped)
    sources, targets = (src.rows, trg.rows) if late else (src, trg)
    gold = D.gold(D.encode(tests, sources, targets, fold_case, KEY), KEY)
    found = D.coverage(tests, sources, targets, fold_case, KEY)
    asked = gold.select("space", F.col("src_idx").alias("idx")).distinct()
    queries = sources.join(asked, [*KEY, "idx"], "left_semi")
    keys = KEY
    if late:
        models = src.maps.select("space", "model").distinct()                # a row a model
        keys, queries = [*KEY, "model"], Mapped(queries, src.maps)
        gold, found = (df.join(F.broadcast(models), "space") for df in (gold, found))
    if method == "nn":
        cands = R.nn_topk(queries, trg, 10, space="space")
    else:
        cands = R.csls_topk(queries, trg, R.nbr_mean(trg, src, csls_k, space="space"), 10, space="space")
    acc = S.precision_at_k(cands, gold, keys=keys)
    return found.join(acc, keys, "left").withColumn("n_queries", F.coalesce("n_queries", F.lit(0).cast("bigint"))).select(*keys, *METRICS)
