"""Bidirectional dictionary induction by CSLS inside frequency cut-offs.

For the first ``x_cutoff`` source ids and ``z_cutoff`` target ids (all by default):
``r_x``/``r_z`` are k-largest means inside the cut-offs, every source row gets
its best target by ``2xz − r_x − r_z`` (``fwd``) and every target row its best
source (``bwd``).  Two block passes: one for both neighbourhoods, one for both
directions (left and right top-1 of the same score block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import knn
from lexalign.operators import retrieval as R


def induce_dictionary(xw: DataFrame, zw: DataFrame, x_cutoff: int | None = None, z_cutoff: int | None = None,
                      csls_k: int = 10, block: int | None = None, r_x: DataFrame | None = None,
                      r_z: DataFrame | None = None) -> DataFrame:
    """``(direction, src_idx, trg_idx)``: ``fwd`` and ``bwd`` rows.

    Without cut-offs the whole vocabularies take part; neighbourhoods that are known
    for what takes part may be given.
    """
    def cut(df: DataFrame, cutoff: int | None) -> DataFrame:
        return (df if cutoff is None else df.where(F.col("idx") < cutoff)).select("idx", "vec")
    xs, zs = cut(xw, x_cutoff), cut(zw, z_cutoff)
    if r_x is None or r_z is None:
        r_x, r_z = R.neighbourhood(xs, zs, csls_k, block=block)
    xb = xs.join(r_x.select("idx", (-F.col("r")).alias("nb")), "idx")
    zb = zs.join(r_z.select("idx", (-F.col("r")).alias("nb")), "idx")
    c = knn.block_candidates(xb, zb, 1, left_bias="nb", right_bias="nb", alpha=2.0,
                             sides=("left", "right"), block=block)
    back = F.col("right_side")
    return knn.final_both(c, 1).select(
        F.when(back, "bwd").otherwise("fwd").alias("direction"),
        F.when(back, F.col("other")).otherwise(F.col("key")).alias("src_idx"),
        F.when(back, F.col("key")).otherwise(F.col("other")).alias("trg_idx"))
