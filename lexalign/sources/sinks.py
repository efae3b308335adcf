"""Sinks: model tables, aligned embeddings, candidate lines, translation pairs, metrics.

Model parameters are small (``d x r`` per language, bounded by the dimension)
and are written as a parquet table ``(fit_id, name, i, vec)``; the optional
text export writes one space-separated file per matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.functions.formatting import percent
from lexalign.operators.fit import Model
from lexalign.sources import vectext

MODEL_SCHEMA = "fit_id string, name string, i int, vec array<double>"


def model_frame(spark: SparkSession, model: Model, fit_id: str = "fit") -> DataFrame:
    rows = []
    for lang, u in model.U.items():
        rows += [(fit_id, f"U_{lang}", i, [float(x) for x in r]) for i, r in enumerate(u)]
    rows += [(fit_id, "B", i, [float(x) for x in r]) for i, r in enumerate(model.B)]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def write_model(spark: SparkSession, model: Model, path: str, fit_id: str = "fit",
                text: bool = False, table: bool = True) -> None:
    """Parquet model table, and (``text=True``) ``<name>.csv`` space-separated text files."""
    df = model_frame(spark, model, fit_id)
    if table:
        df.write.mode("overwrite").parquet(f"{path}/model.parquet")
    if text:
        for name in [r["name"] for r in df.select("name").distinct().collect()]:
            (df.where(F.col("name") == name).orderBy("i")
               .select(F.concat_ws(" ", F.transform("vec", lambda x: x.cast("string"))).alias("v"))
               .coalesce(1).write.mode("overwrite").text(f"{path}/{name}.csv"))


def children(spark: SparkSession, path: str) -> dict[str, str]:
    """Name -> path of the entries of a folder on any Hadoop file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(hpath)}


def _text_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """A matrix of white-space separated numbers, one row a line, in line order."""
    rows = sorted((r["line"], r["value"].split()) for r in vectext.read_lines(spark, path).collect() if r["value"].strip())
    return np.array([[float(x) for x in values] for _, values in rows])


def read_model(spark: SparkSession, path: str, fit_id: str | None = None) -> Model:
    """Model from the parquet table, or from text matrices ``U_<lang>.csv`` / ``B.csv``.

    A text matrix may be a plain file or a folder written by ``write_model``.
    A missing ``B``, or no ``U`` at all, is an error.
    """
    entries = children(spark, path)
    if "model.parquet" in entries:
        df = spark.read.parquet(entries["model.parquet"])
        if fit_id is not None:
            df = df.where(F.col("fit_id") == fit_id)
        mats: dict[str, dict[int, list[float]]] = {}
        for r in df.select("name", "i", "vec").collect():      # d x r numbers a language
            mats.setdefault(r["name"], {})[r["i"]] = r["vec"]
        arr = {k: np.array([v[i] for i in sorted(v)]) for k, v in mats.items()}
    else:
        names = {n: n.removesuffix(".csv") for n in entries if n.endswith(".csv")}
        arr = {m: _text_matrix(spark, entries[n]) for n, m in names.items() if m == "B" or m.startswith("U_")}
    U = {k[2:]: v for k, v in arr.items() if k.startswith("U_")}
    if "B" not in arr or not U:
        raise ValueError(f"no model in {path}: found {sorted(arr) or 'no matrix'}")
    return Model(U, arr["B"], {"path": path})


def write_aligned(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Aligned (mapped, normalised) vocabularies per language.

    ``fmt='vec'`` writes ``<path>/emb_<lang>.vec`` text directories; the
    default writes one parquet table partitioned by ``lang``.
    """
    if fmt == "vec":
        for lang, df in tables.items():
            vectext.write_vec(df, f"{path}/emb_{lang}.vec")
        return
    out = None
    for lang, df in tables.items():
        d = df.select(F.lit(lang).alias("lang"), "idx", "word", "vec")
        out = d if out is None else out.unionByName(d)
    out.write.mode("overwrite").partitionBy("lang").parquet(path)


def candidate_lines(cands: DataFrame, gold: DataFrame, src_emb: DataFrame, trg_emb: DataFrame,
                    legacy_order: bool = False, delim: str = ",") -> DataFrame:
    """``(src_word, line)`` with ``line = src,gold1:gold2,cand1:…:candk``.

    Gold words are sorted; candidates are best first (``legacy_order=True``
    lists them worst first as the reference file does).
    """
    sw = src_emb.select(F.col("idx").alias("src_idx"), F.col("word").alias("src_word"))
    tw = trg_emb.select(F.col("idx").alias("trg_idx"), F.col("word").alias("trg_word"))
    g = (gold.join(tw, "trg_idx").groupBy("src_idx")
             .agg(F.concat_ws(":", F.array_sort(F.collect_set("trg_word"))).alias("gold")))
    c = (cands.join(tw, "trg_idx").groupBy("src_idx")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "trg_word"))).alias("c")))
    seq = F.col("c.trg_word")
    if legacy_order:
        seq = F.reverse(seq)
    return (c.join(g, "src_idx").join(sw, "src_idx")
             .select("src_word", F.concat_ws(delim, "src_word", "gold", F.concat_ws(":", seq)).alias("line")))


def translation_lines(pairs: DataFrame) -> DataFrame:
    """``word<TAB>translation`` text lines."""
    return pairs.select(F.concat_ws("\t", "word", "translation").alias("value"))


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """``Name:  12.34%`` text, one line a row, of the shares ``coverage`` and ``acc1/5/10`` that are there."""
    names = [("coverage", "Coverage"), ("acc1", "Accuracy"), ("acc5", "Accuracy(Top 5)"), ("acc10", "Accuracy(Top 10)")]
    parts = [F.concat(F.lit(f"{label}:"), percent(F.col(c))) for c, label in names if c in metrics.columns]
    return metrics.select(F.concat_ws("  ", *parts).alias("value"))


def write_metrics(metrics: DataFrame, path: str, fit_id: str = "fit") -> None:
    """Append one metrics row per run to a parquet table."""
    metrics.withColumn("fit_id", F.lit(fit_id)).withColumn("written_at", F.current_timestamp()) \
        .write.mode("append").parquet(path)
