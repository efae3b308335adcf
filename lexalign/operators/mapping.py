"""Applying linear maps to whole vocabularies.

``apply_matrix`` multiplies the vector column by a small ``d x r`` matrix inside
``mapInArrow`` (one BLAS product per Arrow batch).  The matrix is a model
parameter whose size depends on the dimension only, never on the data, so it
travels with the task closure.  Pure map: no shuffle, partitioning preserved.

``apply_keyed`` applies another matrix to the rows of every space. The matrices of many
pairs and models are a table ``(space, i, row)`` that never reaches the driver: rows are dealt into
blocks of a space, and each block is co-grouped with its space's matrix. Where many models map the same rows,
``late`` leaves the product to the tasks that read the rows, so no mapped table is written or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexalign.operators._arrow import list_to_matrix, matrix_to_list
from lexalign.operators.fit import Model


def apply_matrix(df: DataFrame, m: np.ndarray, vec: str = "vec", out: str | None = None) -> DataFrame:
    """``out = vec · m`` for every row (other columns passed through)."""
    out = out or vec
    m = np.asarray(m, dtype=np.float64)
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()), True)])
    names = [f.name for f in schema.fields]

    def kernel(batches):
        for batch in batches:
            x = list_to_matrix(batch.column(vec), m.shape[0]) if batch.num_rows else np.zeros((0, m.shape[0]))
            y = matrix_to_list(x @ m) if batch.num_rows else pa.array([], pa.list_(pa.float64()))
            cols = []
            for name in names:
                if name == out:
                    cols.append(y)
                else:
                    cols.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(kernel, schema)


#: Bytes of the vectors that a task maps at once.
BLOCK_BYTES = 1 << 26
#: Rows of one product.
SLAB = 1024


@dataclass
class Mapped:
    """``rows(space, idx, word, vec)`` under every model's matrix ``maps(space, model, i, row)``, scaled to length one, not yet multiplied."""

    rows: DataFrame
    maps: DataFrame


def map_rows(x: np.ndarray, m: np.ndarray, unit: bool = False) -> np.ndarray:
    """``x`` times ``m``; ``unit`` scales the results to length one (zero stays zero).

    Products of one shape only, so that equal rows have equal results wherever they stand.
    """
    slabs = np.zeros((-(-len(x) // SLAB), SLAB, x.shape[1]))
    slabs.reshape(-1, x.shape[1])[:len(x)] = x
    y = (slabs @ m).reshape(-1, m.shape[1])[:len(x)]
    if unit:
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        y = y / np.where(norm > 0, norm, 1.0)
    return y


def apply_keyed(df: DataFrame, maps: DataFrame, counts: dict[int, int] | None = None, dim: int = 64, unit: bool = False,
                late: bool = False) -> DataFrame | Mapped:
    """``(space, idx, word, vec)`` with ``vec`` times the matrix ``maps(space, i, row)`` of its space.

    ``counts`` holds the rows of every space; ``unit`` scales the results to length one (zero stays zero).
    Rows of a space without a matrix or a count are dropped. With ``late`` a space has many matrices, ``maps(space, model, i, row)``,
    results have length one, and the searches of ``operators.retrieval`` multiply the rows when they read them.
    """
    if late:
        if not unit:
            raise ValueError("what is mapped late has length one")
        return Mapped(df, maps)
    spark = df.sparkSession
    rows = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    blocks = spark.createDataFrame([(s, -(-n // rows)) for s, n in counts.items()], "space bigint, _n bigint")   # a row a space
    dealt = df.join(F.broadcast(blocks), "space").select(
        "space", F.pmod(F.xxhash64("idx"), F.col("_n")).alias("_block"), "idx", "word", "vec")
    placed = maps.join(F.broadcast(blocks), "space").select(
        "space", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_block"), "i", "row")

    def multiply(vectors: pa.Table, matrix: pa.Table) -> pa.Table:
        if not vectors.num_rows or not matrix.num_rows:
            vectors = vectors.slice(0, 0)
            y = np.zeros((0, 1))
        else:
            m = list_to_matrix(matrix.column("row"))[np.argsort(matrix.column("i").to_numpy())]
            y = map_rows(list_to_matrix(vectors.column("vec"), len(m)), m, unit)
        return pa.table([*(vectors.column(c) for c in ("space", "idx", "word")), matrix_to_list(y)],
                        names=["space", "idx", "word", "vec"])

    return dealt.groupBy("space", "_block").cogroup(placed.groupBy("space", "_block")) \
        .applyInArrow(multiply, "space bigint, idx bigint, word string, vec array<double>")


def to_latent(df: DataFrame, model: Model, lang: str, vec: str = "vec") -> DataFrame:
    """``x · U_lang · B^{1/2}`` (shared latent space)."""
    return apply_matrix(df, model.latent_map(lang), vec)


def to_language(df: DataFrame, model: Model, src: str, trg: str, vec: str = "vec") -> DataFrame:
    """``x · U_src · B · U_trgᵀ`` (source vectors expressed in the target space)."""
    return apply_matrix(df, model.cross_map(src, trg), vec)


def apply_mapping(df: DataFrame, model: Model, src: str, trg: str | None = None,
                  latent_space: bool = True, vec: str = "vec") -> DataFrame:
    """Dispatch of the reference ``apply_mapping``: latent map or cross-space map."""
    if latent_space or trg is None:
        return to_latent(df, model, src, vec)
    return to_language(df, model, src, trg, vec)


def compose(*maps: np.ndarray) -> np.ndarray:
    """``W₁₂ · W₂₃ · …`` (two-hop composition)."""
    out = maps[0]
    for m in maps[1:]:
        out = out @ m
    return out
