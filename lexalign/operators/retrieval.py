"""Nearest-neighbour and CSLS retrieval on top of the block top-k join.

* ``neighbourhood``: one block product ``X x Z`` gives both ``r_x`` (mean of the
  k largest similarities of each query row) and ``r_z`` (the same for every
  target row against all of ``X``).
* ``csls_topk``: ranks targets by ``2·x·z − r_z`` (``r_x`` is constant per
  query and does not change the order) and reports ``2·x·z − r_x − r_z``.
* ``nn_topk``: plain inner-product ranking.

All ids are the ``idx`` columns of the embedding tables; ties go to the lower id. With
``space``, the name of a column of all inputs, each space is searched by itself, all of
them in one job, and the results carry the column. Sides that are ``mapping.Mapped`` are searched under every model
of their space (``operators.bymodel``): means are an array of one a model, and candidates carry the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexalign.operators import bymodel, knn, pruned
from lexalign.operators.mapping import Mapped
from lexalign.session import materialise


def _ids_vecs(df: DataFrame, vec: str = "vec", space: str | None = None) -> DataFrame:
    return df.select(*([space] if space else []), "idx", F.col(vec).alias("vec"))


def _keyed(df: DataFrame, space: str | None) -> DataFrame:
    """The result of a join without spaces has no such column; with them it is named as the inputs'."""
    return df.drop("space") if space is None else df.withColumnRenamed("space", space)


def _on(space: str | None) -> list[str]:
    return [space] if space else []


def neighbourhood(x: DataFrame, z: DataFrame, k: int = 10, queries: DataFrame | None = None,
                  block: int | None = None, n_left: int | None = None,
                  n_right: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(r_x(idx, r), r_z(idx, r))`` from one product; ``r_x`` only for ``queries`` (all of ``x`` if None).

    The means are written once, as both are read from the same candidates.
    """
    left = _ids_vecs(x)
    emit = None
    if queries is not None:
        q = queries.select(F.col("idx").alias("_q")).distinct().withColumn("_emit", F.lit(True))
        left = left.join(q, left["idx"] == q["_q"], "left").select(
            "idx", "vec", F.coalesce("_emit", F.lit(False)).alias("_emit"))
        emit = "_emit"
    c = knn.block_candidates(left, _ids_vecs(z), k, left_emit=emit, sides=("left", "right"),
                             block=block, n_left=n_left, n_right=n_right)
    means = materialise(knn.final_both(c, k).groupBy("right_side", F.col("key").alias("idx"))
                        .agg(F.avg("score").alias("r")), "neighbourhoods")
    return means.where("not right_side").drop("right_side"), means.where("right_side").drop("right_side")


def nbr_mean(x: DataFrame | Mapped, z: DataFrame | Mapped, k: int = 10, block: int | None = None,
             n_left: int | None = None, n_right: int | None = None, space: str | None = None) -> DataFrame:
    """Mean of the k largest similarities of every ``x`` row against ``z``: ``(idx, r)``.

    Written once: what is joined with the means is counted before it is searched, and would compute them anew each time.
    """
    if isinstance(x, Mapped):
        return materialise(bymodel.nbr_means(x, z, k), "neighbourhoods")
    c = knn.block_candidates(_ids_vecs(x, space=space), _ids_vecs(z, space=space), k, sides=("left",), block=block,
                             n_left=n_left, n_right=n_right, space=space)
    means = materialise(knn.final_topk(c, k, "left").groupBy("space", "key").agg(F.avg("score").alias("r")), "neighbourhoods")
    return _keyed(means, space).withColumnRenamed("key", "idx")


def nn_topk(queries: DataFrame | Mapped, z: DataFrame | Mapped, k: int = 10, block: int | None = None,
            n_left: int | None = None, n_right: int | None = None, space: str | None = None) -> DataFrame:
    """``(src_idx, rank, trg_idx, score)`` by inner product."""
    if isinstance(queries, Mapped):
        return bymodel.topk(queries, z, k)
    t = knn.topk(_ids_vecs(queries, space=space), _ids_vecs(z, space=space), k, block=block, n_left=n_left,
                 n_right=n_right, space=space)
    return _keyed(t, space).select(*_on(space), F.col("l_idx").alias("src_idx"), "rank", F.col("r_idx").alias("trg_idx"), "score")


def csls_topk(queries: DataFrame | Mapped, z: DataFrame | Mapped, r_z: DataFrame, k: int = 10,
              r_x: DataFrame | None = None, block: int | None = None, n_left: int | None = None,
              n_right: int | None = None, space: str | None = None) -> DataFrame:
    """``(src_idx, rank, trg_idx, score)`` by CSLS; score is ``2xz − r_x − r_z`` when ``r_x`` is given."""
    if isinstance(queries, Mapped):
        zb = z.rows.join(r_z.select("space", "idx", F.transform("r", lambda r: -r).alias("nb")), ["space", "idx"])
        return bymodel.topk(queries, Mapped(zb, z.maps), k, 2.0, "nb")
    on = _on(space)
    zb = _ids_vecs(z, space=space).join(r_z.select(*on, "idx", (-F.col("r")).alias("nb")), [*on, "idx"])
    t = knn.topk(_ids_vecs(queries, space=space), zb, k, right_bias="nb", alpha=2.0, block=block,
                 n_left=n_left, n_right=n_right, space=space)
    out = _keyed(t, space).select(*on, F.col("l_idx").alias("src_idx"), "rank", F.col("r_idx").alias("trg_idx"), "score")
    if r_x is not None:
        out = out.join(r_x.select(*on, F.col("idx").alias("src_idx"), F.col("r").alias("rx")), [*on, "src_idx"]) \
                 .withColumn("score", F.col("score") - F.col("rx")).drop("rx")
    return out


def pruned_topk(queries: DataFrame, z: DataFrame, k: int = 10, r_z: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """``nn_topk``, or ``csls_topk`` where ``r_z`` is given, without the block pairs that cannot matter (``operators.pruned``).

    Worth it for many queries against clustered vectors; on others it costs one more pass than the plain product.
    """
    if r_z is None:
        found = pruned.topk(_ids_vecs(queries), _ids_vecs(z), k, block=block)
    else:
        zb = _ids_vecs(z).join(r_z.select("idx", (-F.col("r")).alias("nb")), "idx")
        found = pruned.topk(_ids_vecs(queries), zb, k, alpha=2.0, right_bias="nb", block=block)
    return found.rows.select(F.col("l_idx").alias("src_idx"), "rank", F.col("r_idx").alias("trg_idx"), "score")


def softmax_topn(cands: DataFrame, log: bool = False) -> DataFrame:
    """Softmax of the scores within each query's candidates (``prob`` column)."""
    w = Window.partitionBy("src_idx")
    mx = F.max("score").over(w)
    ex = F.exp(F.col("score") - mx)
    p = ex / F.sum(ex).over(w)
    return cands.withColumn("prob", F.log(p) if log else p)
