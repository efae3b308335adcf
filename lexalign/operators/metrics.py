"""Scores: coverage, precision at k, word-similarity rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.functions import ranking
from lexalign.functions import vector as V
from lexalign.functions.stats import correlation_p_value


def best_hit_rank(cands: DataFrame, gold: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per query ``src_idx``: the best rank of a gold target among its candidates (null if none)."""
    g = gold.select(*keys, "src_idx", "trg_idx").distinct().withColumn("_hit", F.lit(1))
    hit = cands.join(g, [*keys, "src_idx", "trg_idx"], "left")
    return hit.groupBy(*keys, "src_idx").agg(F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("best"))


def precision_at_k(cands: DataFrame, gold: DataFrame, ks=(1, 5, 10), keys: Sequence[str] = ()) -> DataFrame:
    """Share of gold source words with a gold target among the top-k candidates, by ``keys`` if there are any."""
    best = best_hit_rank(cands, gold, keys)
    queries = gold.select(*keys, "src_idx").distinct()
    per_q = queries.join(best, [*keys, "src_idx"], "left")
    aggs = [F.count(F.lit(1)).alias("n_queries")]
    for k in ks:
        aggs.append(F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))).alias(f"acc{k}"))
    return per_q.groupBy(*keys).agg(*aggs)


def evaluation_row(coverage: DataFrame, acc: DataFrame) -> DataFrame:
    """One metrics row: ``n_covered, n_oov, coverage, n_queries, acc1, acc5, acc10``."""
    c = coverage.withColumn("_k", F.lit(0))
    a = acc.withColumn("_k", F.lit(0))
    # both sides are single-row aggregates
    return c.join(F.broadcast(a), "_k").drop("_k")


def word_similarity(emb: DataFrame, sim: DataFrame) -> DataFrame:
    """Spearman ρ between cosine and reference scores over in-vocabulary pairs.

    Returns ``(n_pairs, n_in_vocab, pair_coverage, spearman, p_value)``.  Average ranks
    (ties share the mean rank) come from a distributed global ranking, then
    Pearson correlation of the ranks.  A pair with a zero vector has no cosine: it
    counts as in vocabulary but not in the correlation.
    """
    idx = emb.groupBy("word").agg(F.max_by("vec", "idx").alias("vec"))
    a = idx.select(F.col("word").alias("w1"), F.col("vec").alias("v1"))
    b = idx.select(F.col("word").alias("w2"), F.col("vec").alias("v2"))
    total = sim.agg(F.count(F.lit(1)).alias("n_pairs"))
    # every word of a kept pair must be in vocabulary
    pairs = sim.join(a, "w1").join(b, "w2").select(
        "row_no", V.cosine("v1", "v2").alias("cos"), F.col("ref").cast("double").alias("ref"))
    ranked = ranking.average_rank(pairs, "cos", "r_cos")
    ranked = ranking.average_rank(ranked, "ref", "r_ref")
    stats = ranked.agg(F.count(F.lit(1)).alias("n_in_vocab"), F.count("r_cos").alias("_n"),
                       F.corr("r_cos", "r_ref").alias("spearman")) \
        .withColumn("p_value", correlation_p_value("spearman", "_n")).drop("_n")
    t = total.withColumn("_k", F.lit(0))
    s = stats.withColumn("_k", F.lit(0))
    return (t.join(F.broadcast(s), "_k").drop("_k")
             .withColumn("pair_coverage", F.col("n_in_vocab") / F.col("n_pairs")))
