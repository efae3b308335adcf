"""Manifest-to-metrics job: many languages and dictionaries listed in files.

``run`` reads an embedding manifest (one vector file a line, named by a language list) and
two dictionary manifests (``src_no, trg_no, path`` a line), fits one map a language and the
shared ``B`` on all training dictionaries, and scores all test dictionaries together. The
fitted model, the metrics and, if asked for, the aligned vectors are written; ``apply`` takes a written
model to a vector file by the language's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.operators import mapping as M
from lexalign.operators import normalize as N
from lexalign.operators.fit import Model
from lexalign.plans import multi
from lexalign.session import materialise
from lexalign.sources import dictionaries as DS
from lexalign.sources import sinks, vectext


def read_languages(spark: SparkSession, manifest: str, lang_list: str | None = None, max_voc: int = 0) -> dict[int, tuple[str, DataFrame]]:
    """Number -> (name, ``(idx, word, vec)``) of the listed vector files, each read once."""
    listed = DS.read_embedding_manifest(spark, manifest, lang_list).orderBy("lang_no").collect()      # a row a language
    return {r["lang_no"]: (r["lang"], materialise(vectext.read(spark, r["path"], max_voc), f"vectors-{r['lang_no']}")) for r in listed}


def read_pairs(spark: SparkSession, manifest: str, names: dict[int, str], fold_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """``pairs(space, src_lang, trg_lang)`` and ``words(space, src_word, trg_word)`` of all dictionaries of a manifest.

    The dictionaries of one language pair are one space.
    """
    listed = DS.read_dictionary_manifest(spark, manifest)
    missing = {n for r in listed.collect() for n in (r["src_no"], r["trg_no"])} - set(names)
    if missing:
        raise ValueError(f"{manifest} asks for languages {sorted(missing)}, which the embedding manifest does not list")
    keys = sorted({(r["src_no"], r["trg_no"]) for r in listed.collect()})
    pairs = spark.createDataFrame([(i, a, b, names[a], names[b]) for i, (a, b) in enumerate(keys)],
                                  "space bigint, src_no int, trg_no int, src_lang string, trg_lang string")
    words = DS.read_dictionaries(spark, listed).join(F.broadcast(pairs), ["src_no", "trg_no"]).select("space", "src_word", "trg_word")
    if fold_case:
        words = words.withColumn("src_word", F.lower("src_word")).withColumn("trg_word", F.lower("trg_word"))
    return pairs.select("space", "src_lang", "trg_lang"), materialise(words, "dictionaries")


def run(spark: SparkSession, embeddings: str, train: str, test: str, lang_list: str | None = None, lam: float = 10.0,
        normalize: Sequence[str] = ("unit", "center"), max_voc: int = 0, csls_k: int = 10, model_path: str | None = None,
        metrics_path: str | None = None, aligned_path: str | None = None, aligned_format: str = "parquet",
        fit_id: str = "fit", **limits) -> DataFrame:
    """Metrics ``(src_lang, trg_lang, …)``, a row a test pair; writes what is given a path."""
    languages = read_languages(spark, embeddings, lang_list, max_voc)
    names = {no: name for no, (name, _) in languages.items()}
    if len(set(names.values())) < len(names):
        raise ValueError("two languages of the manifest have one name")
    tables = dict(languages.values())
    train_pairs, train_words = read_pairs(spark, train, names, max_voc > 0)
    parts = [(p["src_lang"], p["trg_lang"], train_words.where(F.col("space") == p["space"]).select("src_word", "trg_word"))
             for p in train_pairs.orderBy("space").collect()]
    used = {x for a, b, _ in parts for x in (a, b)}
    model, norm = multi.fit({k: v for k, v in tables.items() if k in used}, parts, lam, normalize, **limits)
    mapped = multi.mapped_languages(model, norm)
    for df in norm.values():
        df.unpersist()
    pairs, words = read_pairs(spark, test, names, max_voc > 0)
    metrics = materialise(multi.score_pairs(mapped, pairs, words, "csls", csls_k), "metrics")
    if model_path:
        sinks.write_model(spark, model, model_path, fit_id)
    if metrics_path:
        sinks.write_metrics(metrics, metrics_path, fit_id)
    if aligned_path:
        sinks.write_aligned({lang: mapped.where(F.col("lang") == lang).drop("lang") for lang in model.U}, aligned_path, aligned_format)
    return metrics


def apply(spark: SparkSession, model: Model | str, vectors: DataFrame | str, src: str, trg: str | None = None,
          normalize: Sequence[str] = ("unit", "center"), normalize_eval: bool = True, fit_id: str | None = None) -> DataFrame:
    """``(idx, word, vec)`` mapped by a (written) model: into the shared space, or into the space of ``trg``."""
    found = model if isinstance(model, Model) else sinks.read_model(spark, model, fit_id)
    for lang in (src, *([trg] if trg else [])):
        if lang not in found.U:
            raise ValueError(f"the model has no language {lang!r}, only {sorted(found.U)}")
    rows = vectors if isinstance(vectors, DataFrame) else vectext.read(spark, vectors)
    out = M.apply_mapping(N.normalize(rows, normalize), found, src, trg, latent_space=trg is None)
    return N.unit(out) if normalize_eval else out
