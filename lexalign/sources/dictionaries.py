"""Dictionary, similarity-set, word-list and manifest sources; positional paste.

Lines are numbered by the ordered text scan (``vectext.read_lines``) so that
``ord`` keeps the file order of the pairs (duplicates kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.sources.vectext import EDGES, WS, read_files, read_lines


def _stripped(value_col: str = "value"):
    return F.regexp_replace(value_col, EDGES, "")


def _fields(delim: str):
    """Fields of a stripped line between literal delimiters."""
    return F.split(_stripped(), r"\Q" + delim + r"\E")


def _pairs(lines: DataFrame, strict: bool) -> DataFrame:
    """``(..., ord, src_word, trg_word)`` from lines ``(..., line, value)``: two white-space tokens each."""
    rest = [c for c in lines.columns if c not in ("line", "value")]
    toks = F.split(_stripped(), WS)
    checked = F.when(F.size(toks) == 2, toks).otherwise(
        F.raise_error(F.concat(F.lit("dictionary line "), (F.col("line") + 1).cast("string"),
                               F.lit(" does not have two fields"))))
    out = lines.select(*rest, F.col("line").alias("ord"), (checked if strict else toks).alias("t"))
    if not strict:
        out = out.where(F.size("t") == 2)
    return out.select(*rest, "ord", F.col("t")[0].alias("src_word"), F.col("t")[1].alias("trg_word"))


def read_dictionary(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(ord, src_word, trg_word)``: every line must hold exactly two white-space tokens.

    ``strict=True`` fails on any other line, blank ones included; use
    ``read_dictionary_tolerant`` to skip and report them instead.
    """
    return _pairs(read_lines(spark, path), strict)


def read_dictionary_tolerant(spark: SparkSession, path: str, delim: str = " ") -> tuple[DataFrame, DataFrame]:
    """``(pairs, rejected)``: lines split on ``delim`` after stripping; non-2-field lines rejected.

    ``pairs`` is de-duplicated (a multimap of sets); ``rejected`` holds the
    1-based line numbers and raw text.
    """
    lines = read_lines(spark, path)
    toks = _fields(delim)
    t = lines.select((F.col("line") + 1).alias("line_no"), "value", toks.alias("t"))
    pairs = (t.where(F.size("t") == 2)
              .select(F.col("t")[0].alias("src_word"), F.col("t")[1].alias("trg_word"))
              .dropDuplicates(["src_word", "trg_word"]))
    rejected = t.where(F.size("t") != 2).select("line_no", F.col("value").alias("text"))
    return pairs, rejected


def read_similarity(spark: SparkSession, path: str, delim: str = "\t") -> DataFrame:
    """``(row_no, w1, w2, ref)`` from the first three fields of each stripped line."""
    lines = read_lines(spark, path)
    t = _fields(delim)
    return lines.select(F.col("line").alias("row_no"), t[0].alias("w1"), t[1].alias("w2"),
                        t[2].cast("double").alias("ref"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One request word per line (stripped, empty lines dropped): ``(word)``."""
    return (spark.read.text(path).select(_stripped().alias("word"))
                 .where(F.length("word") > 0))


def paste(left: DataFrame, right: DataFrame, left_cols=("value",), right_cols=("value",)) -> DataFrame:
    """Column paste of two line-numbered tables by position (``line``)."""
    a = left.select("line", *[F.col(c).alias(f"l_{c}") for c in left_cols])
    b = right.select("line", *[F.col(c).alias(f"r_{c}") for c in right_cols])
    return a.join(b, "line")


def read_embedding_manifest(spark: SparkSession, path: str, lang_list: str | None = None) -> DataFrame:
    """``(lang_no, lang, path)``: one embedding path per line, language names from ``lang_list``.

    Without a list the languages are named ``0, 1, 2 …``.
    """
    lines = read_lines(spark, path).where(F.length(_stripped()) > 0)
    m = lines.select(F.col("line").cast("int").alias("lang_no"), _stripped().alias("path"))
    if lang_list:
        names = spark.createDataFrame(
            [(i, n.strip()) for i, n in enumerate(lang_list.split(","))], "lang_no int, lang string")
        return m.join(names, "lang_no", "left").select(
            "lang_no", F.coalesce("lang", F.col("lang_no").cast("string")).alias("lang"), "path")
    return m.select("lang_no", F.col("lang_no").cast("string").alias("lang"), "path")


def read_dictionary_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(src_no, trg_no, path)`` from lines ``src_no, trg_no, path``."""
    lines = read_lines(spark, path).where(F.length(_stripped()) > 0)
    t = F.split(_stripped(), r"\s*,\s*")
    return lines.select(t[0].cast("int").alias("src_no"), t[1].cast("int").alias("trg_no"),
                        t[2].alias("path"))


def read_dictionaries(spark: SparkSession, manifest: DataFrame, strict: bool = True) -> DataFrame:
    """All dictionaries of a manifest in one scan: ``(src_no, trg_no, ord, src_word, trg_word)``.

    The manifest has one row a language pair, so its paths are listed on the
    driver; the files are read by one job, each with its own line numbers. A file that
    is listed for several pairs is read for each.
    """
    listed = manifest.select("src_no", "trg_no", "path").collect()
    if not listed:
        return spark.createDataFrame([], "src_no int, trg_no int, ord bigint, src_word string, trg_word string")
    lines = read_files(spark, sorted({r["path"] for r in listed}))
    return _pairs(lines.join(F.broadcast(manifest.select("src_no", "trg_no", "path")), "path").drop("path"), strict)
