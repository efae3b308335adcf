"""Word translation (``translate``) and top-n translation with softmax scores (``translate_topn``).

Request words are joined to the source word index (out-of-vocabulary words
are dropped; ``request_split`` reports them), both vocabularies are
unit-normalised, and retrieval is the block top-k join.  Results are joined
back to words by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.session import materialise


def request_split(words: DataFrame, src_emb: DataFrame) -> DataFrame:
    """``(word, idx, in_vocab)`` for every requested word."""
    idx = D.word_index(src_emb)
    return words.select("word").distinct().join(idx, "word", "left") \
        .withColumn("in_vocab", F.col("idx").isNotNull())


def _candidates(words: DataFrame, src_emb: DataFrame, tgt_emb: DataFrame, method: str,
                k: int, csls_k: int) -> tuple[DataFrame, DataFrame]:
    req = request_split(words, src_emb).where("in_vocab").select("word", "idx")
    xu, zu = (materialise(N.unit(df.select("idx", "vec")), "unit") for df in (src_emb, tgt_emb))     # read several times
    queries = xu.join(req.select("idx").distinct(), "idx", "left_semi")
    if method == "nn":
        c = R.nn_topk(queries, zu, k)
    elif method == "csls":
        r_z = R.nbr_mean(zu, xu, csls_k)        # r_x is constant per word: it changes neither order nor softmax
        c = R.csls_topk(queries, zu, r_z, k)
    else:
        raise ValueError("method must be 'nn' or 'csls'")
    return req, c


def _target_words(tgt_emb: DataFrame) -> DataFrame:
    return tgt_emb.select(F.col("idx").alias("trg_idx"), F.col("word").alias("translation"))


def translate(words: DataFrame, src_emb: DataFrame, tgt_emb: DataFrame, method: str = "csls",
              csls_k: int = 10) -> DataFrame:
    """Best translation of every in-vocabulary request word: ``(word, translation, trg_idx, score)``."""
    req, c = _candidates(words, src_emb, tgt_emb, method, 1, csls_k)
    return (req.join(c.withColumnRenamed("src_idx", "idx"), "idx")
               .join(_target_words(tgt_emb), "trg_idx")
               .select("word", "translation", "trg_idx", "score"))


def translate_topn(words: DataFrame, src_emb: DataFrame, tgt_emb: DataFrame, method: str = "csls",
                   topn: int = 5, csls_k: int = 10, log: bool | None = None) -> DataFrame:
    """Top-n translations with a softmax over their scores.

    ``prob`` holds probabilities (``csls``) or log-probabilities (``nn``) as in
    the reference; ``log`` overrides.  ``r_x`` is constant per word, so the
    softmax of CSLS scores does not depend on it.
    """
    req, c = _candidates(words, src_emb, tgt_emb, method, topn, csls_k)
    as_log = (method == "nn") if log is None else log
    c = R.softmax_topn(c, log=as_log)
    return (req.join(c.withColumnRenamed("src_idx", "idx"), "idx")
               .join(_target_words(tgt_emb), "trg_idx")
               .select("word", "rank", "translation", "trg_idx", "score", "prob"))
