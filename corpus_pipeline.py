"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all that its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``:

1. ``quality_rules``: documents that fail the base rules or lie outside their
   language's perplexity bands go;
2. ``simhash_dedup``: of each group of near-duplicates the document with the smallest id stays;
3. ``suffix_dedup``: passages of 50 bytes and more that a smaller document has are
   cut out of the texts; ``n_chars`` follows;
4. ``mix_sources``: every document once at least, sources repeated by temperature
   weights up to one and a half times (rows drawn again are repeated);
5. ``pack``: the pieces of all texts with their sequences and places.

SQL cannot express the perplexity model, the components, the spans or the packing,
so there is no statement for the whole; the tests compare it with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexalign.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from lexalign.llm.common import table, written
from lexalign.llm.tokens import default_path
from lexalign.session import ship_package


def _stage(run):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, docs, sf_dir)
    return stage


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality_rules", _stage(quality_rules.keep_good)),
    ("simhash_dedup", _stage(simhash.keep_one_of_each)),
    ("suffix_dedup", _stage(suffix_dedup.cut_repeats)),
    ("mix_sources", _stage(mixing.realise_mix)),
    ("pack", _stage(pack)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
