"""Jobs from files to files: evaluate two vector files on a dictionary file, map a vector file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lexalign.operators import mapping as M
from lexalign.operators import normalize as N
from lexalign.operators.fit import Model
from lexalign.plans import bilingual as BL
from lexalign.session import materialise
from lexalign.sources import dictionaries as DS
from lexalign.sources import vectext


def evaluate_files(spark: SparkSession, src_path: str, trg_path: str, dict_path: str, max_voc: int = 0,
                   normalize: Sequence[str] = ("unit",), method: str = "csls", csls_k: int = 10) -> DataFrame:
    """Coverage and precision@1/5/10 of a dictionary file between two (aligned) vector files.

    With ``max_voc`` the vocabularies are capped and folded, and the dictionary is
    folded with them.
    """
    x = materialise(vectext.read(spark, src_path, max_voc), "vectors")
    z = materialise(vectext.read(spark, trg_path, max_voc), "vectors")
    test = DS.read_dictionary(spark, dict_path)
    return BL.evaluate(N.normalize(x, normalize), N.normalize(z, normalize), test, x, z, method, csls_k,
                       fold_case=max_voc > 0)


def map_embedding_db(spark: SparkSession, path: str, model: Model, lang: str, out: str, max_voc: int = 0,
                     normalize: Sequence[str] = ("unit",), normalize_eval: bool = True) -> None:
    """Scan a vector file, map it into the latent space of ``model`` and write a vector file."""
    mapped = M.to_latent(N.normalize(vectext.read(spark, path, max_voc), normalize), model, lang)
    vectext.write_vec(materialise(N.unit(mapped) if normalize_eval else mapped, "mapped"), out)
