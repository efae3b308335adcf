"""Exact top-k by inner product that leaves out block pairs which cannot matter.

Rows of both sides are dealt to the nearest of a few pivots, and a pivot's rows make balls
of bounded size: a pivot, a radius and the largest bias. No score of two balls is above

    alpha * (<a, b> + r_a |b| + r_b |a| + r_a r_b) + max bias_a + max bias_b.

The balls of the right side are taken in the order of that bound, for each left ball a few at first, then twice as
many each round. After a round every left row has a running k-th score; a right ball whose bound is
below the least of a left ball's k-th scores is never multiplied with it. Ties are kept, so the result is that of ``knn.topk``.

If the first round leaves more than ``WORTH`` of all pairs open, the rest is computed in one go: on data without clusters
the bounds cut little, and further rounds would only cost jobs.

The driver holds the balls' pivots, radii and thresholds: ``MOST_BALLS`` a side at most, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import knn
from lexalign.operators._arrow import list_to_matrix
from lexalign.session import materialise

MOST_BALLS = 1024
#: Rows that the pivots are chosen from: those that come first by a hash of their id.
SAMPLE = 4096
#: Right balls of a left ball in the first round.
FIRST = 2
WORTH = 0.6
#: Relative slack of the bounds, far above the rounding of products.
SLACK = 1e-9


@dataclass
class Balls:
    """Rows ``(ball, id, vec, bias)`` and, by ball, the pivot, radius, number of rows and largest bias."""

    rows: DataFrame
    pivot: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    bias: np.ndarray


@dataclass
class Pruned:
    """The result and how much of the work it took."""

    rows: DataFrame
    pairs: int
    computed: int
    rounds: list[int] = field(default_factory=list)


def make_balls(df: DataFrame, n_rows: int, block: int, id_col: str = "idx", vec: str = "vec", bias: str | None = None) -> Balls:
    """Balls of about ``block`` rows; a pivot with more rows has several balls, dealt by a hash of the id."""
    spark = df.sparkSession
    n_pivots = max(1, min(MOST_BALLS // 2, -(-n_rows // block)))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vec"),
                     (F.col(bias).cast("double") if bias else F.lit(0.0)).alias("bias"))
    first = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(SAMPLE).select("vec").collect()
    pivots = choose_pivots(np.array([r["vec"] for r in first], dtype=np.float64), n_pivots)
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, p = list_to_matrix(batch.column(1)), shared.value
            near = np.argmin((p * p).sum(axis=1) - 2.0 * (x @ p.T), axis=1)
            away = np.linalg.norm(x - p[near], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)],
                                             names=["id", "vec", "bias", "pivot", "away"])

    kind = df.schema[vec].dataType.simpleString()
    dealt = materialise(rows.mapInArrow(deal, f"id bigint, vec {kind}, bias double, pivot int, away double"), "balls")
    sizes = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}          # a row a pivot
    parts = {p: max(1, min(-(-n // block), MOST_BALLS // 2 * n // max(1, n_rows) + 1)) for p, n in sizes.items()}
    start = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist()))
    table = spark.createDataFrame([(p, start[p], parts[p]) for p in parts] or [(-1, 0, 1)], "pivot int, _first int, _parts int")
    placed = dealt.join(F.broadcast(table), "pivot") \
        .withColumn("ball", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int"))
    total = sum(parts.values())
    radius, n, most = np.zeros(total), np.zeros(total, dtype=np.int64), np.zeros(total)
    for r in placed.groupBy("ball").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.max("bias").alias("b")).collect():
        radius[r["ball"]], n[r["ball"]], most[r["ball"]] = r["r"], r["n"], r["b"]
    centre = np.concatenate([np.repeat(pivots[[p]], parts[p], axis=0) for p in parts]) if parts else np.zeros((0, 0))
    return Balls(placed.select("ball", "id", "vec", "bias"), centre, radius, n, most)


def choose_pivots(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """``n`` centres of a sample at most: far from each other at first, then moved to the mean of what is near them."""
    chosen, away = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    pivots = sample[chosen].copy()
    for _ in range(steps):
        near = np.argmin((pivots * pivots).sum(axis=1) - 2.0 * (sample @ pivots.T), axis=1)
        size = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return pivots


def bounds(left: Balls, right: Balls, alpha: float) -> np.ndarray:
    """The largest score that any two rows of each pair of balls may have."""
    a, b = np.linalg.norm(left.pivot, axis=1)[:, None], np.linalg.norm(right.pivot, axis=1)[None, :]
    ra, rb = left.radius[:, None], right.radius[None, :]
    reach = (a + ra) * (b + rb)
    return alpha * (left.pivot @ right.pivot.T + ra * b + rb * a + ra * rb + SLACK * reach) + left.bias[:, None] + right.bias[None, :] + SLACK


def _multiply(left: Balls, right: Balls, chosen: np.ndarray, k: int, alpha: float) -> DataFrame:
    """Candidates ``(ball, space, right_side, key, other, score)`` of the chosen pairs of balls."""
    spark = left.rows.sparkSession
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(chosen))] or [(-1, -1)]
    kernel = knn._kernel_factory(k, alpha, ("left",))

    def run(group: tuple, lt: pa.Table, rt: pa.Table) -> pa.Table:
        found = kernel((pa.scalar(0),), lt, rt)
        return found.append_column("ball", pa.array([group[0].as_py()] * found.num_rows, pa.int32()))

    sides = [(left, "lblk"), (right, "rblk")]
    dealt = [side.rows.join(F.broadcast(spark.createDataFrame(pairs, "lblk int, rblk int")), F.col("ball") == F.col(own)).select("lblk", "rblk", "id", "vec", "bias", F.lit(True).alias("emit"))
             for side, own in sides]
    return dealt[0].groupBy("lblk", "rblk").cogroup(dealt[1].groupBy("lblk", "rblk")).applyInArrow(run, knn.CAND_SCHEMA + ", ball int")


def topk(left: DataFrame, right: DataFrame, k: int, *, alpha: float = 1.0, right_bias: str | None = None, block: int | None = None,
         left_id: str = "idx", right_id: str = "idx", vec: str = "vec") -> Pruned:
    """Top-k right rows of every left row, ``(l_idx, r_idx, score, rank)``, and the pairs of balls it took."""
    spark = left.sparkSession
    n_left, n_right = knn.row_counts(left, right)
    if not n_left or not n_right:
        return Pruned(spark.createDataFrame([], "l_idx bigint, r_idx bigint, score double, rank int"), 0, 0)
    if alpha <= 0:
        raise ValueError("the bounds need a positive alpha")
    if block is None:
        dim = right.select(F.size(vec).alias("d")).first()["d"]
        block = max(256, min(knn.BLOCK_BYTES // (8 * max(1, dim)), -(-max(n_left, n_right) // 64)))
    ls = make_balls(left, n_left, block, left_id, vec)
    rs = make_balls(right, n_right, block, right_id, vec, right_bias)
    reach = bounds(ls, rs, alpha)
    order = np.argsort(-reach, axis=1, kind="stable")
    open_ = (ls.n[:, None] > 0) & (rs.n[None, :] > 0)
    pairs, width, rounds, best = int(open_.sum()), FIRST, [], None
    while open_.any():
        rank = np.argsort(order, axis=1)
        passed = np.cumsum(np.take_along_axis(open_, order, axis=1), axis=1)          # open balls up to each, best bound first
        chosen = open_ & (np.take_along_axis(passed, rank, axis=1) <= width)
        rounds.append(int(chosen.sum()))
        found = _multiply(ls, rs, chosen, k, alpha)
        best = materialise(_merge(found if best is None else best.drop("rank").unionByName(found), k), "pruned")
        open_ &= ~chosen
        threshold = np.full(len(ls.n), -np.inf)
        rows = best.groupBy("ball", "key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        for r in rows.groupBy("ball").agg(F.count_if(F.col("n") >= min(k, n_right)).alias("full"), F.min("s").alias("s")).collect():    # a row a ball
            if r["full"] == ls.n[r["ball"]]:
                threshold[r["ball"]] = r["s"]
        open_ &= reach >= threshold[:, None]
        width = 2 * width if open_.sum() <= WORTH * pairs else reach.shape[1]
    out = best.select(F.col("key").alias("l_idx"), F.col("other").alias("r_idx"), "score", "rank")
    return Pruned(out, pairs, sum(rounds), rounds)


def _merge(cands: DataFrame, k: int) -> DataFrame:
    ranked = knn.final_topk(cands.withColumn("space", F.col("ball").cast("bigint")), k, "left")
    return ranked.select(F.col("space").cast("int").alias("ball"), F.lit(0).cast("bigint").alias("space"), F.lit(False).alias("right_side"),
                         "key", "other", "score", F.col("rank").cast("int").alias("rank")) \
        .select("space", "right_side", "key", "other", "score", "ball", "rank")
