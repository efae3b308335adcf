"""Dictionary operators: index, encode, OOV, distinct rows, edges, gold, gaps.

A dictionary is ``(ord, src_word, trg_word[, part])``; an embedding table is
``(idx, word, vec)``.  Lookups are equi joins on ``word`` against the word
index (``max(idx)`` per word: the last duplicate wins), so Spark chooses a
broadcast or a shuffled join from the measured sizes.  Hot words (one word in
a third of the pairs) only ever meet a unique index row, so a skewed key is a
skewed *stream* side that AQE splits; nothing is collected per word.

With ``keys`` (columns of all inputs) many dictionaries and vocabularies are handled at
once: words meet within their key only, and results are by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexalign.operators._arrow import list_to_matrix


def word_index(emb: DataFrame, word: str = "word", idx: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """``word -> idx`` with the last (highest id) duplicate winning."""
    return emb.groupBy(*keys, word).agg(F.max(idx).alias(idx))


def filter_embeddings(emb: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows for which the predicate ``keep(word, vec)`` holds; it is a column expression, so it stays in the plan."""
    return emb.where(keep(F.col("word"), F.col("vec")))


def filter_embeddings_batch(emb: DataFrame, keep: Callable[[list[str], np.ndarray], Sequence[bool]]) -> DataFrame:
    """Rows for which a Python predicate holds: ``keep(words, vectors)`` gets an Arrow batch at a time, vectors as a matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chosen = keep(batch.column("word").to_pylist(), list_to_matrix(batch.column("vec")))
                yield batch.filter(pa.array(np.asarray(chosen, dtype=bool)))
    return emb.mapInArrow(run, emb.schema)


def fold(dic: DataFrame, enabled: bool = True) -> DataFrame:
    """Lower-case both dictionary sides (done when a vocabulary cap is requested)."""
    if not enabled:
        return dic
    return dic.withColumn("src_word", F.lower("src_word")).withColumn("trg_word", F.lower("trg_word"))


def lookup(dic: DataFrame, src_emb: DataFrame, trg_emb: DataFrame, how: str = "inner",
           keys: Sequence[str] = ()) -> DataFrame:
    """Attach ``src_idx`` / ``trg_idx`` (null when out of vocabulary for ``how='left'``)."""
    si = word_index(src_emb, keys=keys).select(*keys, F.col("word").alias("src_word"), F.col("idx").alias("src_idx"))
    ti = word_index(trg_emb, keys=keys).select(*keys, F.col("word").alias("trg_word"), F.col("idx").alias("trg_idx"))
    return dic.join(si, [*keys, "src_word"], how).join(ti, [*keys, "trg_word"], how)


def encode(dic: DataFrame, src_emb: DataFrame, trg_emb: DataFrame, fold_case: bool = False,
           keys: Sequence[str] = ()) -> DataFrame:
    """Pairs whose two words are in vocabulary, order and duplicates kept."""
    d = fold(dic, fold_case)
    return lookup(d, src_emb, trg_emb, "inner", keys)


def oov_pair_count(dic: DataFrame, src_emb: DataFrame, trg_emb: DataFrame,
                   fold_case: bool = False) -> DataFrame:
    d = lookup(fold(dic, fold_case), src_emb, trg_emb, "left")
    return d.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("src_idx").isNull() | F.col("trg_idx").isNull()).alias("n_oov_pairs"),
        F.count_if(F.col("src_idx").isNotNull() & F.col("trg_idx").isNotNull()).alias("n_in_vocab"),
    )


def distinct_rows(enc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct source ids and distinct target ids of an encoded dictionary."""
    return enc.select("src_idx").distinct(), enc.select("trg_idx").distinct()


def edges(enc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Binary alignment ``A``: distinct ``(src_idx, trg_idx)``."""
    return enc.select(*keys, "src_idx", "trg_idx").dropDuplicates([*keys, "src_idx", "trg_idx"])


def weighted_edges(enc: DataFrame) -> DataFrame:
    """Pairs with multiplicity (self-training cost counts duplicates)."""
    return enc.groupBy("src_idx", "trg_idx").agg(F.count(F.lit(1)).alias("weight"))


def gold(enc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The gold multimap as a long table ``(src_idx, trg_idx)``."""
    return edges(enc, keys)


def oov_words(dic: DataFrame, src_emb: DataFrame, trg_emb: DataFrame,
              fold_case: bool = False) -> DataFrame:
    """Source words none of whose pairs is fully in vocabulary."""
    d = lookup(fold(dic, fold_case), src_emb, trg_emb, "left")
    bad = d.where(F.col("src_idx").isNull() | F.col("trg_idx").isNull()).select(F.col("src_word").alias("word"))
    good = d.where(F.col("src_idx").isNotNull() & F.col("trg_idx").isNotNull()).select(F.col("src_word").alias("word"))
    return bad.join(good, "word", "left_anti").distinct()


def coverage(dic: DataFrame, src_emb: DataFrame, trg_emb: DataFrame,
             fold_case: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """``|src with gold| / (|src with gold| + |OOV words|)`` (null when both are 0)."""
    d = lookup(fold(dic, fold_case), src_emb, trg_emb, "left", keys)
    ok = F.col("src_idx").isNotNull() & F.col("trg_idx").isNotNull()
    per_word = d.groupBy(*keys, "src_word").agg(F.max(ok.cast("int")).alias("ok"),
                                                F.first("src_idx", ignorenulls=True).alias("src_idx"))
    covered = F.count_distinct(F.when(F.col("ok") == 1, F.col("src_idx")))
    oov = F.count_if(F.col("ok") == 0)
    return per_word.groupBy(*keys).agg(covered.alias("n_covered"), oov.alias("n_oov")).select(
        *keys, "n_covered", "n_oov",
        F.when(F.col("n_covered") + F.col("n_oov") > 0,
               F.col("n_covered") / (F.col("n_covered") + F.col("n_oov"))).alias("coverage"))


def vocab_gap(dicts: list[DataFrame], emb: DataFrame, side: str = "src", keys: Sequence[str] = ()) -> DataFrame:
    """Words of ``side`` in any of the dictionaries but not in the vocabulary."""
    col = f"{side}_word"
    words = None
    for d in dicts:
        w = d.select(*keys, F.col(col).alias("word"))
        words = w if words is None else words.unionByName(w)
    return words.distinct().join(emb.select(*keys, "word"), [*keys, "word"], "left_anti")


def reverse(dic: DataFrame) -> DataFrame:
    """Swap source and target columns."""
    cols = [c for c in dic.columns if c not in ("src_word", "trg_word")]
    return dic.select(*cols, F.col("trg_word").alias("src_word"), F.col("src_word").alias("trg_word"))


def exclude_sources(full: DataFrame, held_out: DataFrame) -> DataFrame:
    """Full dictionary minus every pair whose source word is held out."""
    return full.join(held_out.select("src_word").distinct(), "src_word", "left_anti")


def stats(enc: DataFrame) -> DataFrame:
    """Distinct source / target counts and pair count of an encoded dictionary."""
    return enc.agg(F.count(F.lit(1)).alias("n_pairs"),
                   F.count_distinct("src_idx").alias("n_src"),
                   F.count_distinct("trg_idx").alias("n_trg"),
                   F.count_distinct("src_idx", "trg_idx").alias("n_edges"))
