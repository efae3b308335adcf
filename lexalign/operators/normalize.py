"""Vector normalisations (``unit``, ``center``, ``unitdim``, ``centeremb``).

Row-wise steps are higher-order Column expressions.  Column-wise steps need one
aggregate per group (language): ``Summarizer`` computes the mean / L2 norm of
every dimension in one pass with partial aggregation; the per-group result
(``d`` doubles per language, a size bound that does not grow with the
vocabulary) is applied as a literal array, or by a broadcast join with one row per
group, so the big side is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexalign.functions import vector as V

STEPS = ("unit", "center", "unitdim", "centeremb", "none")


def unit(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, V.unit(vec))


def centeremb(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn(vec, V.shift(vec, V.vmean(vec)))


def column_stats(df: DataFrame, vec: str = "vec", group_cols: Sequence[str] = (),
                 metric: str = "mean") -> dict[tuple, list[float]]:
    """Per-group ``mean`` / ``normL2`` of every dimension (one Summarizer pass).

    The result is ``#groups x d`` numbers, bounded by the number of languages
    and the dimension; it is fitted once and applied as a literal, like a
    fitted scaler model.
    """
    summ = Summarizer.metrics(metric).summary(array_to_vector(F.col(vec))).alias("_s")
    rows = df.groupBy(*group_cols).agg(summ).select(
        *group_cols, vector_to_array(F.col(f"_s.{metric}")).alias("_stat")).collect()
    return {tuple(r[c] for c in group_cols): list(r["_stat"]) for r in rows}


def _apply(df: DataFrame, vec: str, stats: dict[tuple, list[float]], group_cols: Sequence[str], op) -> DataFrame:
    """``op(vec, statistic)`` on every row: a literal without groups, else a join with one row a group."""
    if not group_cols:
        if not stats:
            return df
        return df.withColumn(vec, op(vec, F.array(*[F.lit(float(x)) for x in next(iter(stats.values()))])))
    fields = [T.StructField(f"_g{i}", df.schema[c].dataType) for i, c in enumerate(group_cols)]
    rows = [(*k, [float(x) for x in v]) for k, v in stats.items()]
    table = df.sparkSession.createDataFrame(rows, T.StructType([*fields, T.StructField("_stat", T.ArrayType(T.DoubleType()))]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)])
    return df.join(F.broadcast(table), same).withColumn(vec, op(vec, "_stat")) \
             .drop("_stat", *[f"_g{i}" for i in range(len(group_cols))])


def center(df: DataFrame, vec: str = "vec", group_cols: Sequence[str] = ()) -> DataFrame:
    return _apply(df, vec, column_stats(df, vec, group_cols, "mean"), group_cols, V.sub)


def unitdim(df: DataFrame, vec: str = "vec", group_cols: Sequence[str] = ()) -> DataFrame:
    stats = column_stats(df, vec, group_cols, "normL2")
    safe = {k: [x if x != 0 else 1.0 for x in v] for k, v in stats.items()}
    return _apply(df, vec, safe, group_cols, V.div_elementwise)


def normalize(df: DataFrame, steps: Sequence[str], vec: str = "vec",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Apply the steps in order (the ``--normalize a b ...`` chain)."""
    out = df.withColumn(vec, F.col(vec).cast("array<double>"))
    for step in steps:
        if step == "unit":
            out = unit(out, vec)
        elif step == "center":
            out = center(out, vec, group_cols)
        elif step == "unitdim":
            out = unitdim(out, vec, group_cols)
        elif step == "centeremb":
            out = centeremb(out, vec)
        elif step == "none":
            continue
        else:
            raise ValueError(f"unknown normalisation step {step!r}; expected one of {STEPS}")
    return out
