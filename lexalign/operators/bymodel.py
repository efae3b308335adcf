"""Exact top-k of two tables under many models at once, from the vectors before they are mapped.

The models of a grid map the same rows again and again. Mapped tables, and block products of them, would be
shuffled and written once a model; here the vectors travel as they are and the maps are applied in the task:

* left rows are dealt into blocks by a hash of the id, a block is a task. A task gets the maps of its
  space first, then its left rows, then all right rows of the space in the order in which they come, and holds
  ``CHUNK_BYTES`` of these at a time. A right row travels once a left block, a left row once, whatever the number of
  models, and as the lists that leave a task are final, there are no partial ones to merge;
* models whose scores are near each other share one product. With unit vectors ``a`` and ``b`` of a model and
  ``a0`` and ``b0`` of another, ``|<a, b> - <a0, b0>| <= |a - a0| + |b - b0|``, once the latent spaces are turned
  to each other. These lengths are known for every row, so a pair's score under one
  model bounds those under all; they are added to the rounding of the kernel in ``operators.knn``, and what may be
  among the ``k`` best of any model is scored in double under each. Which models share a product decides the work only.

Ties go to the lower id. Rows that are not finite meet nothing. Results are those of ``operators.knn`` on the mapped rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexalign.operators import knn
from lexalign.operators._arrow import list_to_matrix, matrix_to_list
from lexalign.operators.knn import COLUMNS, GROUP, LEAST, PAIRS, ROWS, _best, _copies, _likely, _Near
from lexalign.operators.mapping import SLAB, Mapped, map_rows
from lexalign.session import default_parallelism

#: Bytes of the right rows that a task holds at once; a left block has ``knn.BLOCK_BYTES``.
CHUNK_BYTES = 1 << 23
#: Models share a product if their scores differ by at most this part of the scores' standard deviation, on most of ``SAMPLE`` rows.
NEAR, SAMPLE = 0.25, 256
#: Stands for a null id among the right rows, and for an empty place.
NOBODY = np.iinfo(np.int64).max

LEFT_MAP, RIGHT_MAP, LEFT, RIGHT = range(4)
MEANS_SCHEMA = "space bigint, idx bigint, r array<double>"
TOPK_SCHEMA = "space bigint, model int, src_idx bigint, rank int, trg_idx bigint, score double"


def _turned(maps: list[tuple[np.ndarray, np.ndarray]], to: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every model's maps with its latent space turned to that of ``to``, which changes no score."""
    out = []
    for left, right in maps:
        u, _, vt = np.linalg.svd(left.T @ to[0] + right.T @ to[1])
        out.append((left @ (u @ vt), right @ (u @ vt)))
    return out


def _alike(maps: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, bias: np.ndarray, alpha: float) -> list[list[int]]:
    """Groups of models that share a product, the one that stands for a group first; from a few rows of both sides."""
    near = np.zeros((len(maps), len(maps)), dtype=bool)
    for g, own in enumerate(maps):
        a0, b0 = map_rows(x, own[0], True), map_rows(y, own[1], True)
        most = NEAR * abs(alpha) * (a0 @ b0.T).std()
        for m, (left, right) in enumerate(_turned(maps, own)):
            far = [np.quantile(np.linalg.norm(map_rows(v, w, True) - v0, axis=1), 0.95) for v, w, v0 in ((x, left, a0), (y, right, b0))]
            near[g, m] = g == m or abs(alpha) * sum(far) + np.quantile(np.abs(bias[:, m] - bias[:, g]), 0.95) <= most
    groups, rest = [], np.ones(len(maps), dtype=bool)
    while rest.any():
        g = int(np.argmax(np.where(rest, (near & rest).sum(axis=1), -1)))
        groups.append([g, *(int(m) for m in np.flatnonzero(near[g] & rest) if m != g)])
        rest[groups[-1]] = False
    return groups


class _NearAny(_Near):
    """What may be among the ``k`` best of some rows under any model; ``exact`` gives a row of scores a model."""

    def settle(self) -> None:
        i, j = self._joined()[:2]
        score = self.exact(i, j)
        kept = np.zeros(len(i), dtype=bool)
        for one in score:
            order = np.lexsort((j, -one, i))
            first = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])
            kept[order[np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < self.k]] = True
        low, high = (f(score[:, kept], axis=0).astype(np.float32) for f in (np.min, np.max))
        self.parts = [(i[kept], j[kept], np.nextafter(low, np.float32(-np.inf)), np.nextafter(high, np.float32(np.inf)))]
        self.held = int(kept.sum())
        self.prune()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        self.prune()
        return self._joined()[:2] if self.held else (np.zeros(0, dtype=np.int64),) * 2


class _Block:
    """The running lists of one left block; right rows are added chunk by chunk."""

    def __init__(self, maps: dict[int, dict[int, np.ndarray]], ids: np.ndarray, x: np.ndarray, k: int, alpha: float):
        self.k, self.alpha = k, alpha
        self.models = sorted(maps[LEFT_MAP])
        width = max(m.shape[1] for m in maps[LEFT_MAP].values())
        self.maps = [tuple(np.pad(maps[side][m], ((0, 0), (0, width - maps[side][m].shape[1]))) for side in (LEFT_MAP, RIGHT_MAP))
                     for m in self.models]
        finite = np.isfinite(x).all(axis=1)
        if not finite.all():
            ids, x = ids[finite], x[finite]
        self.ids = ids
        order, group, place = _copies(x, np.zeros(len(x)))
        self.x = x[order[place == 0]]                            # equal rows are searched once
        self.row = np.empty(len(x), dtype=np.int64)
        self.row[order] = group
        self.n = len(self.x)
        self.score = np.full((len(self.models) * self.n, k), -np.inf)     # by model and row
        self.other = np.full((len(self.models) * self.n, k), NOBODY)
        self.least = np.full((len(self.models), self.n), -np.inf)
        self.groups = None

    def _prepare(self, y: np.ndarray, bias: np.ndarray) -> None:
        """The groups of models, and of each the left rows in single precision and how far its models are from them."""
        some = np.linspace(0, self.n - 1, min(self.n, SAMPLE)).astype(np.int64)
        self.groups = []
        for members in _alike(self.maps, self.x[some], y[:SAMPLE], bias[:SAMPLE], self.alpha):
            own = self.maps[members[0]]
            maps = _turned([self.maps[m] for m in members], own)
            single = np.empty((self.n, own[0].shape[1] + 1), dtype=np.float32)
            spread, scale = np.zeros(self.n), np.empty((len(members), self.n))
            for p in range(0, self.n, 8 * SLAB):
                rows = slice(p, p + 8 * SLAB)
                a0 = map_rows(self.x[rows], own[0], True)
                single[rows, :-1], single[rows, -1] = self.alpha * a0, 1.0
                for q, (left, _) in enumerate(maps):
                    a = map_rows(self.x[rows], left)
                    length = np.linalg.norm(a, axis=1)
                    scale[q, rows] = np.where(length > 0, 1.0, 0.0) / np.where(length > 0, length, 1.0)
                    spread[rows] = np.maximum(spread[rows], np.linalg.norm(a * scale[q, rows, None] - a0, axis=1))
            self.groups.append((np.array(members), own, maps, single, abs(self.alpha) * spread, scale))

    def add(self, ids: np.ndarray, y: np.ndarray, bias: np.ndarray) -> None:
        finite = np.isfinite(y).all(axis=1) & np.isfinite(bias).all(axis=1)
        by_id = np.argsort(ids, kind="stable")
        by_id = by_id[finite[by_id]]
        ids, y, bias = ids[by_id], y[by_id], bias[by_id]
        if not len(ids) or not self.n:
            return
        order, _, place = _copies(np.column_stack([y, bias]), np.zeros(len(y)))
        if (place >= self.k).any():                              # of equal right rows only the first k can matter
            kept = np.sort(order[place < self.k])
            ids, y, bias = ids[kept], y[kept], bias[kept]
        if self.groups is None:
            self._prepare(y, bias)
        for group in self.groups:
            self._add(ids, y, bias, *group)

    def _add(self, ids, y, bias, members, own, maps, single, spread, scale) -> None:
        k, alpha, d = self.k, self.alpha, single.shape[1]
        b0, far = map_rows(y, own[1], True), np.zeros(len(y))
        pulled = []                                              # right rows in the left rows' own space, a matrix a model
        for left, right in maps:
            b = map_rows(y, right, True)
            far = np.maximum(far, np.linalg.norm(b - b0, axis=1))
            pulled.append(map_rows(b, left.T))
        yb = bias[:, members[0]]
        far = abs(alpha) * far + np.abs(bias[:, members] - yb[:, None]).max(axis=1)
        near_first = np.argsort(far, kind="stable")              # so that few tiles have the wide bounds
        b32 = np.column_stack([b0, yb]).astype(np.float32)[near_first]
        b32 = np.concatenate([b32, np.repeat(b32[-1:], -len(y) % GROUP, axis=0)])
        step = max(1, COLUMNS // GROUP) * GROUP
        starts = range(0, len(y), step)
        rounding = (d + 16) * 2.0 ** -23
        slacks = [rounding * (abs(alpha) + float(np.abs(yb[near_first[c:c + step]]).max())) + LEAST + float(far[near_first[c:c + step]].max())
                  for c in starts]
        scores, largest = np.empty(step * ROWS, dtype=np.float32), np.empty(step // GROUP * ROWS, dtype=np.float32)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.empty((len(members), len(i)))
            for p in range(0, len(i), PAIRS):
                at, to = i[p:p + PAIRS], j[p:p + PAIRS]
                x = self.x[at]
                for q, m in enumerate(members):
                    out[q, p:p + PAIRS] = alpha * scale[q][at] * np.einsum("ij,ij->i", x, pulled[q][to]) + bias[to, m]
            return out

        for a in range(0, self.n, ROWS):
            rows = slice(a, a + ROWS)
            n = len(single[rows])
            near = _NearAny(n, k, lambda i, j: exact(i + a, j))
            near.least = self.least[members, rows].min(axis=0)
            due = 0
            for t, c in enumerate(starts):
                width, groups = min(step, len(y) - c), len(b32[c:c + step]) // GROUP
                s = scores[:groups * GROUP * n].reshape(groups * GROUP, n)
                np.matmul(b32[c:c + step], single[rows].T, out=s)
                slack = slacks[t] + spread[rows]
                least = near.least - slack
                if not np.isfinite(least).all():
                    least = np.maximum(least, _likely(s[:width].T, k) - 2 * slack)
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                grouped, top = s.reshape(groups, GROUP, n), largest[:groups * n].reshape(groups, n)
                np.maximum.reduce(grouped, axis=1, out=top)
                at = np.flatnonzero(top >= least)
                if len(at):
                    group = at // n
                    i = at - group * n
                    value = grouped[group, :, i]
                    which, place = np.nonzero(value >= least[i, None])
                    i, j, value = i[which], group[which] * GROUP + place, value[which, place]
                    if width < len(s):
                        real = j < width
                        i, j, value = i[real], j[real], value[real]
                    near.add(i, near_first[j + c], np.nextafter((value - slack[i]).astype(np.float32), np.float32(-np.inf)),
                             np.nextafter((value + slack[i]).astype(np.float32), np.float32(np.inf)))
                if t >= due:
                    near.prune()
                    due = 4 * t + 3
            i, j = near.pairs()
            if len(i):
                i = i + a
                found = exact(i, j)
                at, what = np.nonzero(found >= self.least[members[:, None], i[None, :]])
                self._insert(members[at] * self.n + i[what], ids[j[what]], found[at, what])

    def _insert(self, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        """Each list's worst gives way to what is better; a list is met once a turn."""
        row, other, score = _best(row, other, score, self.k)
        if not len(row):
            return
        first = np.flatnonzero(np.r_[True, np.diff(row) != 0])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        for turn in range(int(place.max()) + 1):
            now = place == turn
            at, what, value = row[now], other[now], score[now]
            own, named = self.score[at], self.other[at]
            worst = own.min(axis=1)
            last = np.where(own == worst[:, None], named, -1 - NOBODY).argmax(axis=1)
            wins = (value > worst) | ((value == worst) & (what < named[np.arange(len(at)), last]))
            self.score[at[wins], last[wins]], self.other[at[wins], last[wins]] = value[wins], what[wins]
        seen = row[first]
        self.least.reshape(-1)[seen] = self.score[seen].min(axis=1)

    def lists(self, m: int):
        """``(id, other, score)`` of the ``k`` best of every id under the ``m``-th model, in order; rows of one id count together."""
        at = m * self.n + self.row
        key, other, score = np.repeat(self.ids, self.k), self.other[at].ravel(), self.score[at].ravel()
        real = score > -np.inf
        return _best(key[real], other[real], score[real], self.k)

    def means(self, space: int) -> pa.RecordBatch | None:
        means, ids = [], None
        for m in range(len(self.models)):
            ids, _, score = self.lists(m)
            if not len(ids):
                return None
            first = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
            means.append(np.add.reduceat(score, first) / np.diff(np.r_[first, len(ids)]))
            ids = ids[first]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), space), pa.int64()), pa.array(ids, pa.int64()),
                                           matrix_to_list(np.column_stack(means))], names=["space", "idx", "r"])

    def ranked(self, space: int, m: int) -> pa.RecordBatch:
        key, other, score = self.lists(m)
        first = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)])) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), space), pa.int64()), pa.array(np.full(len(key), self.models[m]), pa.int32()), pa.array(key, pa.int64()),
             pa.array(rank, pa.int32()), pa.array(other, pa.int64(), mask=other == NOBODY), pa.array(score, pa.float64())],
            names=["space", "model", "src_idx", "rank", "trg_idx", "score"])


def _kernel_factory(k: int, alpha: float, means: bool):
    def kernel(batches):
        space, block = None, None
        maps: dict[int, dict] = {LEFT_MAP: {}, RIGHT_MAP: {}}
        left, right, held = [], [], 0

        def start():
            if not left or not maps[LEFT_MAP]:
                return None
            matrices = {side: {m: np.array([row for _, row in sorted(rows.items())]) for m, rows in found.items()} for side, found in maps.items()}
            ids, x = (np.concatenate(c) for c in zip(*left))
            left.clear()
            return _Block(matrices, ids, x, k, alpha)

        def add():
            ids, y, bias = (np.concatenate(c) for c in zip(*right))
            right.clear()
            block.add(ids, y, bias if bias.shape[1] else np.zeros((len(y), len(block.models))))

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column("kind").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, len(kinds)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                rows = batch.slice(begin, end - begin)
                kind, space = int(kinds[begin]), rows.column("space")[0].as_py()
                ids = rows.column("id").fill_null(NOBODY).to_numpy()
                if kind in maps:                                 # of any rank
                    for m, i, row in zip(rows.column("model").to_numpy(), ids, rows.column("vec")):
                        maps[kind].setdefault(int(m), {})[int(i)] = row.values.to_numpy()
                    continue
                vecs = list_to_matrix(rows.column("vec"))
                if kind == LEFT:
                    left.append((ids, vecs))
                else:
                    block = block or start()
                    if block is None:
                        return
                    biases = rows.column("bias")
                    right.append((ids, vecs, list_to_matrix(biases) if biases.null_count == 0 else np.zeros((len(ids), 0))))
                    held += vecs.nbytes
                    if held >= CHUNK_BYTES:
                        add()
                        held = 0
        if block is None:
            return
        if right:
            add()
        if means:
            made = block.means(space)
            if made is not None:
                yield made
        else:
            for m in range(len(block.models)):
                yield block.ranked(space, m)

    return kernel


def choose_tasks(counts: dict[int, tuple[int, int]], parallelism: int, dim: int) -> dict[int, int]:
    """Left blocks of every space: as many as memory needs, and all spaces together as many as run at once."""
    total = sum(n * m for n, m in counts.values())
    return {s: min(-(-n // knn.MIN_BLOCK), max(-(-8 * dim * n // knn.BLOCK_BYTES), math.ceil(parallelism * n * m / total)))
            for s, (n, m) in counts.items()}


def _product(left: Mapped, right: Mapped, k: int, alpha: float, right_bias: str | None, means: bool) -> DataFrame:
    spark = left.rows.sparkSession
    known = {r["space"] for r in left.maps.select(F.col("space").cast("bigint").alias("space")).distinct().collect()}     # a row a space
    found = knn.space_counts(left.rows.where("idx is not null"), right.rows, "space")
    counts = {s: c for s, c in found.items() if s in known}
    if not counts:
        return spark.createDataFrame([], MEANS_SCHEMA if means else TOPK_SCHEMA)
    first = right.rows.select(F.size("vec").alias("d")).first()
    tasks = choose_tasks(counts, default_parallelism(spark), first["d"])
    begun, total = [], 0
    for s, q in tasks.items():
        begun.append((s, total, q))
        total += q
    placed = F.broadcast(spark.createDataFrame(begun, "_space bigint, _base bigint, _q bigint"))     # a row a space
    every = F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_q") - 1))
    none = F.lit(None).cast("array<double>")

    def rows(df: DataFrame, kind: int, task, model, number: str, vec: str, bias=none) -> DataFrame:
        return df.join(placed, F.col("space") == F.col("_space")).select(
            task.alias("task"), F.lit(kind).cast("int").alias("kind"), F.col("space").cast("bigint").alias("space"),
            model.cast("int").alias("model"), F.col(number).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec"), bias.alias("bias"))

    own = F.col("_base") + F.pmod(F.xxhash64(F.col("idx").cast("bigint")), F.col("_q"))
    parts = [rows(left.maps, LEFT_MAP, every, F.col("model"), "i", "row"), rows(right.maps, RIGHT_MAP, every, F.col("model"), "i", "row"),
             rows(left.rows.where("idx is not null"), LEFT, own, F.lit(0), "idx", "vec"),
             rows(right.rows, RIGHT, every, F.lit(0), "idx", "vec", F.col(right_bias).cast("array<double>") if right_bias else none)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.repartitionById(total, F.col("task").cast("int")).sortWithinPartitions("kind") \
        .mapInArrow(_kernel_factory(int(k), float(alpha), means), MEANS_SCHEMA if means else TOPK_SCHEMA)


def nbr_means(x: Mapped, z: Mapped, k: int) -> DataFrame:
    """``(space, idx, r)``: for every row of ``x`` the mean of its ``k`` largest scores, one a model in the order of the models."""
    return _product(x, z, k, 1.0, None, True)


def topk(queries: Mapped, z: Mapped, k: int, alpha: float = 1.0, right_bias: str | None = None) -> DataFrame:
    """``(space, model, src_idx, rank, trg_idx, score)``; ``right_bias`` names a column with a number a model."""
    return _product(queries, z, k, alpha, right_bias, False)
