"""lexalign: cross-lingual word-embedding alignment and retrieval on Spark.

Subpackages
-----------
sources    readers/writers for vector text files, dictionaries, manifests,
           models and the shared parquet tables
functions  Column expressions (vector algebra, ranks, formatting)
operators  DataFrame -> DataFrame operators (normalisation, dictionaries,
           grams, fits, mappings, k-NN / CSLS retrieval, metrics, OOV)
plans      end-to-end jobs (bilingual, multilingual, self-training, two-hop)
streaming  the stateless projections applied to streaming DataFrames
"""

__version__ = "0.1.0"
