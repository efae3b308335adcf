"""Vocabulary extension for out-of-vocabulary words.

* ``prefix_embeddings``: the vector of an unseen word is the mean of the
  vector of its longest in-vocabulary prefix and of the shortest vocabulary
  word that extends it, found by a walk over the sorted words
  (``operators.prefix``). With a ``space`` column on both sides every language's
  requests are looked up in its own vocabulary, all of them in one job.
* ``external_vectors``: vectors from an external command (``RDD.pipe``).
* ``prepend``: new rows first, original ids shifted.
"""

from __future__ import annotations

import shlex
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexalign.operators import dictionary as D
from lexalign.operators.prefix import prefix_search
from lexalign.session import materialise
from lexalign.sources import vectext
from lexalign.sources.vectext import WS


def prefix_matches(words: DataFrame, emb: DataFrame, longer: bool = True, ranges: int | None = None) -> DataFrame:
    """``(space, word, short_idx, short_word, long_idx)`` for each OOV request word ``(space, word)``."""
    vocab = D.word_index(emb, keys=["space"])                   # (space, word, idx), last duplicate wins
    found = prefix_search(words.select("space", "word"), vocab, ranges)
    long_idx = F.col("long_idx") if longer else F.lit(None).cast("bigint")
    out = found.select("space", "word", "short_idx", F.expr("substring(word, 1, short_len)").alias("short_word"), long_idx.alias("long_idx"))
    return out.where(F.col("short_idx").isNotNull() | F.col("long_idx").isNotNull())


def prefix_embeddings(words: DataFrame, emb: DataFrame, longer: bool = True, ranges: int | None = None) -> DataFrame:
    """``(word, vec, short_word, long_word)``: mean of the matched vectors; unmatched and in-vocabulary words dropped.

    If ``words`` and ``emb`` have a ``space`` column, so has the result.
    """
    keyed = "space" in words.columns and "space" in emb.columns
    words, emb = (df if keyed else df.withColumn("space", F.lit(0).cast("bigint")) for df in (words, emb))
    m = materialise(prefix_matches(words, emb, longer, ranges), "prefix-matches")
    # words without a match must not meet in one task: a null id goes with the word's hash
    for side in ("short", "long"):
        m = m.withColumn(f"_{side}", F.when(F.col(f"{side}_idx").isNull(), F.xxhash64("word")).otherwise(F.lit(0).cast("bigint")))
    none = F.pmod("idx", F.lit(1)).cast("bigint")             # zero, but no literal, which would be no key of the join
    vs = emb.select("space", F.col("idx").alias("short_idx"), none.alias("_short"), F.col("vec").alias("sv"))
    vl = emb.select("space", F.col("idx").alias("long_idx"), none.alias("_long"), F.col("vec").alias("lv"), F.col("word").alias("long_word"))
    j = m.join(vs, ["space", "short_idx", "_short"], "left").join(vl, ["space", "long_idx", "_long"], "left")
    mean = (F.when(F.col("sv").isNotNull() & F.col("lv").isNotNull(),
                   F.zip_with("sv", "lv", lambda a, b: (a + b) / 2.0))
             .when(F.col("sv").isNotNull(), F.col("sv")).otherwise(F.col("lv")))
    return j.select(*(["space"] if keyed else []), "word", mean.alias("vec"), "short_word", "long_word")


def external_vectors(words: DataFrame, command: str, partitions: int | None = None) -> DataFrame:
    """Vectors produced by an external command: words piped to stdin, ``word v1 …`` read from stdout.

    The command runs once per partition (``RDD.pipe``); a non-zero exit code fails the task.
    """
    spark = words.sparkSession
    rdd = words.select("word").rdd.map(lambda r: r[0])
    if partitions:
        rdd = rdd.repartition(partitions)
    out = rdd.pipe(command if isinstance(command, str) else " ".join(map(shlex.quote, command)),
                   checkCode=True)
    lines = spark.createDataFrame(out.map(lambda s: (s,)), T.StructType([T.StructField("value", T.StringType())]))
    parts = F.split(F.trim("value"), WS)
    return lines.where(F.length(F.trim("value")) > 0).select(
        parts[0].alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def prepend(emb: DataFrame, new_rows: DataFrame, order_col: str = "word", keys: Sequence[str] = ()) -> DataFrame:
    """New rows get ids ``0..n_new-1`` (ordered by ``order_col``), original ids shift by ``n_new``; by ``keys`` if there are any."""
    from lexalign.functions import ranking
    cols = [*keys, "word", "vec"] + ([order_col] if order_col not in ("word", "vec") else [])
    order = [*(F.col(k).asc() for k in keys), F.col(order_col).asc()]
    numbered = ranking.row_number_global(new_rows.select(*cols), order, "_pos")
    if keys:
        sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))   # a row a key
        numbered, shifted = numbered.join(F.broadcast(sizes), list(keys)), emb.join(F.broadcast(sizes), list(keys), "left")
    else:
        numbered, shifted = numbered.withColumn("_first", F.lit(1)), emb.withColumn("_n", F.lit(numbered.count()))
    shifted = shifted.select(*keys, (F.col("idx") + F.coalesce("_n", F.lit(0))).cast("bigint").alias("idx"), "word", "vec")
    return numbered.select(*keys, (F.col("_pos") - F.col("_first")).cast("bigint").alias("idx"), "word", "vec").unionByName(shifted)


def extend_with_prefix(dicts: list[DataFrame], emb: DataFrame, side: str = "src",
                       longer: bool = True) -> DataFrame:
    """Dictionary-driven extension: gap words of the dictionaries -> prefix vectors -> prepend.

    If the dictionaries and ``emb`` have a ``space`` column, each space is extended by itself.
    """
    keys = ["space"] if "space" in emb.columns else []
    gap = D.vocab_gap(dicts, emb, side, keys)
    new = prefix_embeddings(gap, emb, longer).select(*keys, "word", "vec")
    return prepend(emb, new, keys=keys)


def extend_file(spark: SparkSession, vectors: str, dicts: list[DataFrame], out: str, side: str = "src", longer: bool = True) -> None:
    """A vector file extended by the words that dictionaries ask for, written as a vector file."""
    emb = materialise(vectext.read(spark, vectors), "vectors")
    vectext.write_vec(materialise(extend_with_prefix(dicts, emb, side, longer), "extended"), out)


def extend_with_external(dicts: list[DataFrame], emb: DataFrame, command: str, side: str = "src") -> DataFrame:
    """Dictionary-driven extension with vectors of an external command."""
    gap = D.vocab_gap(dicts, emb, side)
    new = external_vectors(gap, command)
    return prepend(emb, new)
