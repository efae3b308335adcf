"""Readers for the shared parquet tables and the language tables built on them.

An embedding table has the schema ``(idx bigint, word string, vec array<double>)``
where ``idx`` is the frequency rank (dense from 0).  A dictionary has the schema
``(ord bigint, src_word string, trg_word string[, part string])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def as_language(df: DataFrame, prefix: str, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """``(idx, word = prefix || idx, vec double[])`` from an id/vector table."""
    return df.select(
        F.col(id_col).cast("bigint").alias("idx"),
        F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("word"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
