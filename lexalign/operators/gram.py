"""Gram aggregates: ``XᵀX``, ``XᵀAZ`` and the weighted ``Σ w·x zᵀ``.

Each task folds its Arrow batches into one ``d_a x d_b`` partial in double
(``mapInArrow``: map-side combine), emits it as ``d_a`` rows, and a
``groupBy(i)`` sums the partials with ``Summarizer``.  Shuffle volume is
``#partitions x d_a x d_b`` doubles, independent of the number of rows.  The
only thing that reaches the driver is the final ``d x d`` matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators._arrow import list_to_matrix, matrix_to_list
from lexalign.session import materialise

PARTIAL_SCHEMA = "i int, row array<double>"
#: Partial grams by key that a task holds at once.
HELD_KEYS = 64


def _partial_factory(a: str, b: str | None, w: str | None):
    def partial(batches):
        acc = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            A = list_to_matrix(batch.column(a))
            B = A if b is None else list_to_matrix(batch.column(b))
            if w is not None:
                weights = batch.column(w).to_numpy(zero_copy_only=False).astype(np.float64)
                part = (A * weights[:, None]).T @ B
            else:
                part = A.T @ B
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(acc.shape[0], dtype=np.int32)), matrix_to_list(acc)],
                names=["i", "row"])
    return partial


def gram_rows(df: DataFrame, a: str = "vec", b: str | None = None,
              weight: str | None = None) -> DataFrame:
    """``Σ_rows w · a bᵀ`` as rows ``(i int, row array<double>)``."""
    cols = [a] + ([b] if b else []) + ([weight] if weight else [])
    partials = df.select(*[F.col(c) for c in cols]).mapInArrow(
        _partial_factory(a, b, weight), PARTIAL_SCHEMA)
    summed = partials.groupBy("i").agg(
        Summarizer.metrics("sum").summary(array_to_vector("row")).alias("s"))
    return summed.select("i", vector_to_array(F.col("s.sum")).alias("row"))


def keyed_gram_rows(df: DataFrame, key: str, a: str = "vec", b: str | None = None, weight: str | None = None) -> DataFrame:
    """A gram for every value of ``key`` (a bigint) in one pass: rows ``(key, i, row)``.

    A task holds the partials of ``HELD_KEYS`` keys and passes them on when more come.
    """
    names = [key, a] + ([b] if b else []) + ([weight] if weight else [])

    def emit(held: dict):
        for k, acc in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(acc), k), pa.int64()), pa.array(np.arange(len(acc), dtype=np.int32)), matrix_to_list(acc)],
                names=[key, "i", "row"])

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(key).to_numpy()
            A = list_to_matrix(batch.column(a)) if batch.num_rows else None
            B = A if b is None or A is None else list_to_matrix(batch.column(b))
            if A is not None and weight is not None:
                A = A * batch.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            for k in np.unique(keys):
                at = keys == k
                part = A[at].T @ B[at]
                if k not in held and len(held) >= HELD_KEYS:
                    yield from emit(held)
                    held = {}
                held[k] = held[k] + part if k in held else part
        yield from emit(held)

    partials = df.select(F.col(key).cast("bigint").alias(key), *names[1:]).mapInArrow(partial, f"{key} bigint, {PARTIAL_SCHEMA}")
    summed = partials.groupBy(key, "i").agg(Summarizer.metrics("sum").summary(array_to_vector("row")).alias("s"))
    return summed.select(key, "i", vector_to_array(F.col("s.sum")).alias("row"))


def gram_long(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Long form ``(i, j, value)`` with 0-based indices."""
    out = rows.select(F.col("i").cast("int").alias("i"),
                      F.posexplode("row").alias("j", "value"))
    out = out.select("i", F.col("j").cast("int").alias("j"), "value")
    if digits is not None:
        out = out.withColumn("value", F.round("value", digits))
    return out


def to_numpy(rows: DataFrame) -> np.ndarray:
    """Collect a gram (``d`` rows of ``d`` doubles; bounded by the dimension)."""
    got = rows.collect()
    if not got:
        return np.zeros((0, 0))
    n = max(r["i"] for r in got) + 1
    m = np.zeros((n, len(got[0]["row"])))
    for r in got:
        m[r["i"]] = r["row"]
    return m


def gram(df: DataFrame, vec: str = "vec") -> np.ndarray:
    return to_numpy(gram_rows(df, vec))


def cross_gram(pairs: DataFrame, a: str, b: str, weight: str | None = None) -> np.ndarray:
    return to_numpy(gram_rows(pairs, a, b, weight))


def grams(specs: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Several grams in one Spark job.

    ``specs``: name -> ``(df, a, b_or_None, weight_or_None)``.  The partial rows
    of all grams are unioned and summed together, then collected once.
    """
    parts = None
    for name, (df, a, b, w) in specs.items():
        g = gram_rows(df, a, b, w).withColumn("name", F.lit(name))
        parts = g if parts is None else parts.unionByName(g)
    out: dict[str, list] = {name: [] for name in specs}
    for r in parts.collect():
        out[r["name"]].append(r)
    res = {}
    for name, rows in out.items():
        if not rows:
            res[name] = np.zeros((0, 0))
            continue
        n = max(r["i"] for r in rows) + 1
        m = np.zeros((n, len(rows[0]["row"])))
        for r in rows:
            m[r["i"]] = r["row"]
        res[name] = m
    return res


class PairGrams:
    """The grams of a weighted dictionary, kept up to date by the pairs that come and go.

    ``sxx`` and ``szz`` are over the distinct rows that take part, ``c`` is the sum of ``weight · x zᵀ`` over the pairs
    with their multiplicity. ``update`` joins and multiplies only what differs from the pairs before.
    """

    def __init__(self, x: DataFrame, z: DataFrame, matrices: dict[str, np.ndarray] | None = None, pairs: DataFrame | None = None,
                 n_pairs: int = 0):
        self.x, self.z = x.select("idx", "vec"), z.select("idx", "vec")
        self.matrices, self.pairs, self.n_pairs = dict(matrices or {}), pairs, n_pairs
        #: Distinct pairs that the last update joined with their vectors.
        self.moved = 0

    def update(self, pairs: DataFrame, name: str = "pair-weights") -> None:
        """Go over to ``pairs(src_idx, trg_idx)``, repeated pairs counted as often; null ids are no pairs."""
        new = materialise(pairs.where("src_idx is not null and trg_idx is not null").groupBy("src_idx", "trg_idx")
                          .agg(F.count(F.lit(1)).alias("weight")), name)
        old = self.pairs if self.pairs is not None else new.limit(0)
        before, after = (df.select("src_idx", "trg_idx", (F.col("weight") * sign).alias("weight")) for df, sign in ((old, -1), (new, 1)))
        delta = materialise(before.unionByName(after).groupBy("src_idx", "trg_idx").agg(F.sum("weight").alias("weight"))
                            .where("weight <> 0"), "pair-deltas")

        def rows(column: str, vectors: DataFrame) -> DataFrame:
            """Rows that now take part (1) or no longer do (-1)."""
            side = [df.select(F.col(column).alias("idx")).distinct().withColumn("weight", F.lit(sign)) for df, sign in ((old, -1), (new, 1))]
            return side[0].unionByName(side[1]).groupBy("idx").agg(F.sum("weight").alias("weight")).where("weight <> 0").join(vectors, "idx")

        joined = delta.join(self.x.select(F.col("idx").alias("src_idx"), F.col("vec").alias("xv")), "src_idx") \
            .join(self.z.select(F.col("idx").alias("trg_idx"), F.col("vec").alias("zv")), "trg_idx")
        found = grams({"sxx": (rows("src_idx", self.x), "vec", None, "weight"), "szz": (rows("trg_idx", self.z), "vec", None, "weight"),
                       "c": (joined, "xv", "zv", "weight")})
        for k, m in found.items():
            if m.size:
                self.matrices[k] = self.matrices[k] + m if k in self.matrices and self.matrices[k].size else m
        self.pairs, self.moved = new, delta.count()
        self.n_pairs = new.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
