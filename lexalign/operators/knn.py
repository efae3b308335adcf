"""Exact similarity top-k join (k nearest neighbours by inner product).

Physical design (block matrix product, as in distributed BlockMatrix multiply):

* both inputs are dealt into blocks by a hash of the id, so ids need not be dense;
  the number of blocks follows from the number of rows, and a block's rows from
  ``BLOCK_BYTES`` and the vector length;
* every left row is replicated to the ``T`` right blocks and every right row to
  the ``Q`` left blocks, and the two sides are co-grouped on ``(lblk, rblk)``:
  one group is one block pair. A hundred queries are one block, so the target is
  moved once for them;
* a numpy kernel (``applyInArrow`` on the co-group) goes over tiles of ``ROWS x COLUMNS``
  scores in single precision and leaves out what lies below a row's running k-th score by
  more than the rounding can make up, ``GROUP`` right rows at once where their largest does; the few others are scored in double, and ties go to the lower id.
  Of right rows with equal vectors and biases only the first ``k`` can matter. Vectors that single precision
  cannot hold go through ``TILE x TILE`` scores in double. No memory but the vectors' depends on the block;
* the final top-k is a ``row_number() <= k`` window per key, which Catalyst
  turns into a partial ``WindowGroupLimit`` before the shuffle.

Many joins at once: with a ``space`` column on both sides only rows of the same
space meet (the test pairs of a manifest, the models of a grid). The space is part of
the block key, every space has its own number of blocks, so all spaces run in one
co-group and are merged by one window. The block numbers are a row a space.

Score of a pair: ``alpha * <l, r> + l_bias + r_bias``.  CSLS uses ``alpha = 2``
and ``r_bias = -r_z``.  Only ``k`` rows per key and block survive the kernel,
so the shuffle after the kernel is ``O(n_l * T * k)`` (and ``O(n_r * Q * k)``)
rows, never ``n_l * n_r``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexalign.operators._arrow import list_to_matrix
from lexalign.session import default_parallelism

#: Bytes of the vectors of one block side. A task holds both sides about four times.
BLOCK_BYTES = 1 << 25
MIN_BLOCK = 64
TILE = 2048
#: Scores of one tile in single precision: few enough for a core's own cache.
ROWS, COLUMNS = 768, 512
#: Right rows of a tile whose largest score is compared first.
GROUP = 16
#: Pairs that a search holds before it scores them in double.
HELD = 1 << 20
#: Pairs scored in double at once.
PAIRS = 1 << 16
#: Longest vectors and largest biases whose scores single precision holds, and what it may lose to underflow.
LARGEST, LEAST = 1e15, 1e-25

CAND_SCHEMA = "space bigint, right_side boolean, key bigint, other bigint, score double"


def choose_block(n_left: int, n_right: int, parallelism: int, dim: int = 64,
                 min_block: int = MIN_BLOCK) -> int:
    """Block rows: about ``2 x parallelism`` block pairs, as far as a block fits ``BLOCK_BYTES``."""
    pairs = max(1, 2 * parallelism)
    b = int(math.ceil(math.sqrt(max(1, n_left) * max(1, n_right) / pairs)))
    return max(min_block, min(BLOCK_BYTES // (8 * max(1, dim)), b))


def topk_mask(s: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask of the ``k`` best entries per row: score desc, column asc.

    Columns must be in ascending id order.  Exactly ``min(k, ncols)`` entries
    per row are selected even when scores tie at the boundary.
    """
    n = s.shape[1]
    if k >= n:
        return np.ones_like(s, dtype=bool)
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    gt = s > kth[:, None]
    need = k - gt.sum(axis=1)
    eq = s == kth[:, None]
    eq_rank = np.cumsum(eq, axis=1)
    return gt | (eq & (eq_rank <= need[:, None]))


def _empty() -> pa.Table:
    return _emit(0, False, *(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64)))


def _emit(space: int, right_side: bool, key: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"space": pa.array(np.full(len(key), space), pa.int64()),
                     "right_side": pa.array(np.full(len(key), right_side)), "key": pa.array(key, pa.int64()),
                     "other": pa.array(other, pa.int64()), "score": pa.array(score, pa.float64())})


def _best(key: np.ndarray, other: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` best of every key: score descending, other ascending."""
    order = np.lexsort((other, -score, key))
    key, other, score = key[order], other[order], score[order]
    first = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, dtype=np.int64)
    pos = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    keep = pos < k
    return key[keep], other[keep], score[keep]


class _Running:
    """Running top-k of many keys; merged whenever it has doubled."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.after = k, [], 0, 0

    def add(self, scores: np.ndarray, keys: np.ndarray, others: np.ndarray) -> None:
        i, j = np.nonzero(topk_mask(scores, self.k))
        self.parts.append((keys[i], others[j], scores[i, j]))
        self.held += len(i)
        if self.held > 2 * self.after + 1_000_000:
            self.parts = [self.merged()]
            self.held = self.after = len(self.parts[0][0])

    def merged(self):
        return _best(*(np.concatenate(c) for c in zip(*self.parts)), self.k)


def _side(t: pa.Table):
    ids = t.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    vecs = list_to_matrix(t.column("vec"))[order]
    bias = t.column("bias").to_numpy(zero_copy_only=False).astype(np.float64)[order]
    emit = t.column("emit").to_numpy(zero_copy_only=False).astype(bool)[order]
    return ids[order], vecs, bias, emit


def _fits_single(*values: np.ndarray) -> bool:
    """Whether all numbers are finite and small enough for scores in single precision."""
    return all(bool(np.all(np.abs(v) <= LARGEST)) for v in values)


def _copies(vecs: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows in which equal ones stand together (ascending), the number of each one's group and its place there."""
    rows = np.ascontiguousarray(np.column_stack([vecs, bias])) + 0.0                  # no negative zeros
    same = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    order = np.argsort(same, kind="stable")
    same = same[order]
    head = np.r_[True, same[1:] != same[:-1]]
    group = np.cumsum(head) - 1
    return order, group, np.arange(len(order)) - np.flatnonzero(head)[group]


def _score(x: np.ndarray, xb: np.ndarray, y: np.ndarray, yb: np.ndarray, i: np.ndarray, j: np.ndarray, alpha: float) -> np.ndarray:
    """Scores in double of the pairs of rows ``i`` and ``j``; a pair's does not depend on the others."""
    out = np.empty(len(i))
    for p in range(0, len(i), PAIRS):
        a, b = i[p:p + PAIRS], j[p:p + PAIRS]
        out[p:p + PAIRS] = alpha * np.einsum("ij,ij->i", x[a], y[b]) + xb[a] + yb[b]
    return out


def _likely(s: np.ndarray, k: int) -> np.ndarray:
    """A bound that ``k`` scores of each row reach: the k-th of the largest ones of groups of columns."""
    size = max(1, s.shape[1] // (16 * k))
    groups = s.shape[1] // size
    if groups < k:
        return np.full(len(s), -np.inf)
    top = s[:, :groups * size].reshape(len(s), size, groups).max(axis=1)
    return np.partition(top, groups - k, axis=1)[:, groups - k].astype(np.float64)


def _set(flags: np.ndarray) -> np.ndarray:
    """The places of the few that are set, looked for eight at a time; the length is a multiple of eight."""
    eights = np.flatnonzero(flags.view(np.uint64) != 0)
    at, within = np.nonzero(flags.reshape(-1, 8)[eights])
    return eights[at] * 8 + within


def _kth(row: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest single-precision value of each of ``n`` rows, minus infinity where there are fewer."""
    bits = (value + np.float32(0)).view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))             # ascends with the value
    keys = np.sort(row.astype(np.uint64) << np.uint64(32) | ordered)             # one sort of whole numbers is much faster than of two keys
    counts = np.bincount(row, minlength=n)
    full = np.flatnonzero(counts >= k)
    bits = keys[np.cumsum(counts)[full] - k].astype(np.uint32)
    out = np.full(n, -np.inf)
    out[full] = np.where(bits >> 31, bits & np.uint32((1 << 31) - 1), ~bits).astype(np.uint32).view(np.float32)
    return out


class _Near:
    """What may be among the ``k`` best of some rows: pairs with bounds of their scores."""

    def __init__(self, n: int, k: int, exact):
        self.n, self.k, self.exact = n, k, exact
        self.least = np.full(n, -np.inf)                 # what k scores of each row reach
        self.parts, self.held, self.most = [], 0, max(HELD, 4 * n * k)

    def add(self, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.parts.append((i, j, low, high))
        self.held += len(i)
        if self.held > self.most:
            self.prune()
            if self.held > self.most // 2:               # too many within the rounding: their scores in double decide
                self.settle()

    def settle(self) -> None:
        i, j, score = self.best()
        single = score.astype(np.float32)
        self.parts, self.held = [(i, j, np.nextafter(single, np.float32(-np.inf)), np.nextafter(single, np.float32(np.inf)))], len(i)
        self.prune()

    def _joined(self):
        return tuple(np.concatenate(c) for c in zip(*self.parts))

    def prune(self) -> None:
        if self.held:
            i, j, low, high = self._joined()
            self.least = np.maximum(self.least, _kth(i, low, self.n, self.k))
            kept = high >= self.least[i]
            self.parts = [(i[kept], j[kept], low[kept], high[kept])]
            self.held = len(self.parts[0][0])

    def best(self):
        """``(row, place, score)`` of the ``k`` best of what is held."""
        i, j = self._joined()[:2]
        return _best(i, j, self.exact(i, j), self.k)


def _rows_topk(x: np.ndarray, xb: np.ndarray, y: np.ndarray, yb: np.ndarray, yid: np.ndarray, k: int, alpha: float):
    """``(row of x, id of y, score)`` of the ``k`` best rows of ``y`` for each row of ``x``; ``yid`` ascends, ``k`` is ``len(y)`` at most.

    Equal rows of ``x`` are searched once; of equal rows of ``y`` only the first ``k`` take part.
    """
    order, group, place = _copies(x, xb)
    searched = order[place == 0]
    if len(searched) < len(x):
        _, other, score = _rows_topk(x[searched], xb[searched], y, yb, yid, k, alpha)
        return np.repeat(order, k), other.reshape(-1, k)[group].ravel(), score.reshape(-1, k)[group].ravel()
    order, _, place = _copies(y, yb)
    if (place >= k).any():
        kept = np.sort(order[place < k])
        y, yb, yid = y[kept], yb[kept], yid[kept]
    (i, j, score), _ = _search(x, xb, y, yb, k, alpha)
    return i, yid[j], score


def _both_topk(x: np.ndarray, xb: np.ndarray, xid: np.ndarray, y: np.ndarray, yb: np.ndarray, yid: np.ndarray, k: int, alpha: float,
               wanted: np.ndarray | None = None):
    """What ``_rows_topk`` gives for the rows of ``x`` and for those of ``y``, from one product; None where copies make two cheaper.

    With ``wanted``, a mask, the second result is that of the marked rows of ``y`` only.
    """
    kept, first = [], []
    for vecs, bias in ((x, xb), (y, yb)):
        order, group, place = _copies(vecs, bias)
        kept.append(np.sort(order[place < k]))
        if len(kept[-1]) > 2 * (group[-1] + 1):
            return None
        head = np.empty(len(order), dtype=np.int64)
        head[order] = order[place == 0][group]
        first.append(np.searchsorted(kept[-1], head))
    heads = None
    if wanted is not None:
        heads = np.zeros(len(kept[1]), dtype=bool)
        heads[first[1][wanted]] = True
        first[1] = (np.cumsum(heads) - 1)[first[1][wanted]]
    found = _search(x[kept[0]], xb[kept[0]], y[kept[1]], yb[kept[1]], k, alpha, back=True, wanted=heads)
    out = []
    for (_, j, score), like, ids in zip(found, first, (yid[kept[1]], xid[kept[0]])):          # k of each row, in the order of rows
        out.append((np.repeat(np.arange(len(like)), k), ids[j].reshape(-1, k)[like].ravel(), score.reshape(-1, k)[like].ravel()))
    return out


def _search(x: np.ndarray, xb: np.ndarray, y: np.ndarray, yb: np.ndarray, k: int, alpha: float, back: bool = False,
            wanted: np.ndarray | None = None):
    """``(row, place in y, score)`` of the ``k`` best for each row of ``x`` and, with ``back``, the same for ``y`` from the same scores.

    ``wanted`` marks the rows of ``y`` that ``back`` asks for (all if None); the first of them has number 0 in the second result.
    """
    asked, given, biases = len(y), y, yb
    if wanted is not None:
        places = np.argsort(~wanted, kind="stable")                                      # the marked ones fill the first tiles
        asked, y, yb = int(wanted.sum()), y[places], yb[places]
    a32, b32 = (alpha * x).astype(np.float32), y.astype(np.float32)
    if xb.any() or yb.any():
        a32 = np.column_stack([a32, xb, np.ones(len(x))]).astype(np.float32)
        b32 = np.column_stack([b32, np.ones(len(y)), yb]).astype(np.float32)
    b32 = np.concatenate([b32, np.repeat(b32[-1:], -len(y) % GROUP, axis=0)])             # whole groups; what is too much is left out below
    step = max(1, COLUMNS // GROUP) * GROUP
    length, other = abs(alpha) * np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    rounding = (x.shape[1] + 16) * 2.0 ** -23
    starts = range(0, len(y), step)
    furthest, most = ([float(np.abs(v[c:c + step]).max()) for c in starts] for v in (other, yb))
    scores, above = np.empty(step * ROWS, dtype=np.float32), np.empty(step * ROWS, dtype=bool)
    largest = np.empty(step // GROUP * ROWS, dtype=np.float32)
    found, columns = [], _Near(asked, k, lambda j, i: _score(y, yb, x, xb, j, i, alpha)) if back else None
    turn = 0
    for r, a in enumerate(range(0, len(x), ROWS)):
        rows = slice(a, a + ROWS)
        n = len(x[rows])
        near = _Near(n, k, lambda i, j: _score(x[rows], xb[rows], given, biases, i, j, alpha))
        due = 0
        for t, c in enumerate(starts):
            width, groups = min(step, len(y) - c), len(b32[c:c + step]) // GROUP
            s = scores[:groups * GROUP * n].reshape(groups * GROUP, n)                    # rows of y by rows of x
            np.matmul(b32[c:c + step], a32[rows].T, out=s)
            slack = rounding * (length[rows] * furthest[t] + np.abs(xb[rows]) + most[t]) + LEAST
            least = near.least - slack
            if not np.isfinite(least).all():
                least = np.maximum(least, _likely(s[:width].T, k) - 2 * slack)
            least = least.astype(np.float32)
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
                near.add(i, j + c if wanted is None else places[j + c], (value - slack[i]).astype(np.float32), (value + slack[i]).astype(np.float32))
            if t >= due:                                 # after 1, 4, 16, ... tiles: about 3 k more pairs a row each time
                near.prune()
                due = 4 * t + 3
            width = min(width, asked - c)
            if back and width > 0:
                slack = rounding * (length[rows].max() * other[c:c + width] + np.abs(xb[rows]).max() + np.abs(yb[c:c + width])) + LEAST
                least = columns.least[c:c + width] - slack
                if not np.isfinite(least).all():
                    least = np.maximum(least, _likely(s[:width], k) - 2 * slack)
                end = -(-n * width // 8) * 8
                np.greater_equal(s[:width], least.astype(np.float32)[:, None], out=above[:n * width].reshape(width, n))
                above[n * width:end] = False
                at = _set(above[:end])
                if len(at):
                    j = at // n
                    i = at - j * n
                    value = s.ravel()[at]
                    columns.add(j + c, i + a, (value - slack[j]).astype(np.float32), (value + slack[j]).astype(np.float32))
        near.prune()
        i, j, score = near.best()
        found.append((i + a, j, score))
        if back and r >= turn:
            columns.prune()
            turn = 4 * r + 3
    if back:
        columns.prune()
    return tuple(np.concatenate(p) for p in zip(*found)), columns.best() if back else None


def _dense_topk(lid, L, lb, lemit, rid, R, rb, k: int, alpha: float, want_left: bool, want_right: bool):
    """``(right_side, key, other, score)`` from all scores in double."""
    columns = _Running(k)
    for a in range(0, len(lid), TILE):
        rows = _Running(k)
        emitted = np.flatnonzero(lemit[a:a + TILE])
        for c in range(0, len(rid), TILE):
            s = alpha * (L[a:a + TILE] @ R[c:c + TILE].T) + lb[a:a + TILE, None] + rb[None, c:c + TILE]
            if want_left and len(emitted):
                rows.add(s[emitted], lid[a:a + TILE][emitted], rid[c:c + TILE])
            if want_right:
                columns.add(s.T, rid[c:c + TILE], lid[a:a + TILE])
        if rows.parts:
            yield False, *rows.merged()
    if columns.parts:
        yield True, *columns.merged()


def _kernel_factory(k: int, alpha: float, sides: tuple[str, ...]):
    want_left = "left" in sides
    want_right = "right" in sides

    def kernel(group: tuple, lt: pa.Table, rt: pa.Table) -> pa.Table:
        space = group[0].as_py()
        if lt.num_rows == 0 or rt.num_rows == 0:
            return _empty()
        lid, L, lb, lemit = _side(lt)
        rid, R, rb, _ = _side(rt)
        small = _fits_single(L, lb, R, rb) and abs(alpha) <= 1024
        out = []
        left, right = want_left and small and k < len(rid), want_right and small and k < len(lid)
        both = None
        if left and right and lemit.all():
            both = _both_topk(L, lb, lid, R, rb, rid, k, alpha)
        elif left and right and lemit.any():                   # the side that is wanted whole is searched by rows: that is cheaper
            both = _both_topk(R, rb, rid, L, lb, lid, k, alpha, wanted=lemit)
            both = both and both[::-1]
        if both is not None:
            (i, other, score), (j, back, scored) = both
            return pa.concat_tables([_emit(space, False, lid[lemit][i], other, score), _emit(space, True, rid[j], back, scored)])
        if left and lemit.any():
            i, other, score = _rows_topk(L[lemit], lb[lemit], R, rb, rid, k, alpha)
            out.append(_emit(space, False, lid[lemit][i], other, score))
        if right:
            i, other, score = _rows_topk(R, rb, L, lb, lid, k, alpha)
            out.append(_emit(space, True, rid[i], other, score))
        if want_left > left or want_right > right:
            out += [_emit(space, *found) for found in _dense_topk(lid, L, lb, lemit, rid, R, rb, k, alpha, want_left > left, want_right > right)]
        return pa.concat_tables(out) if out else _empty()

    return kernel


def _prepare(df: DataFrame, id_col: str, vec: str, bias: str | None, emit: str | None, space: str | None,
             grid: DataFrame | None, own_blk: str, other_blk: str, n_own, n_other) -> DataFrame:
    """Rows with their own block, once for each block of the other side, vectors in their own type."""
    if space is not None:
        df = df.join(F.broadcast(grid), df[space] == grid["_space"])       # a row a space
    kind = df.schema[vec].dataType.elementType.typeName()
    vectors = F.col(vec) if kind in ("double", "float") else F.col(vec).cast("array<double>")
    return df.select(
        (F.col(space) if space else F.lit(0)).cast("bigint").alias("space"),
        F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), n_own).alias(own_blk),
        F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1)).alias(other_blk),
        F.col(id_col).cast("bigint").alias("id"), vectors.alias("vec"),
        (F.col(bias).cast("double") if bias else F.lit(0.0)).alias("bias"),
        (F.col(emit).cast("boolean") if emit else F.lit(True)).alias("emit"),
    )


def block_candidates(left: DataFrame, right: DataFrame, k: int, *,
                     left_id: str = "idx", right_id: str = "idx", vec: str = "vec",
                     left_bias: str | None = None, right_bias: str | None = None,
                     left_emit: str | None = None, alpha: float = 1.0,
                     sides: tuple[str, ...] = ("left",), block: int | None = None,
                     n_left: int | None = None, n_right: int | None = None,
                     space: str | None = None) -> DataFrame:
    """Partial top-k candidates per block pair: ``(space, right_side, key, other, score)``.

    ``n_left`` and ``n_right`` are row counts (counted in one job where not given). With
    ``space``, a column of both sides, only rows of one space meet; without, the space is 0.
    """
    spark = left.sparkSession
    if space is not None:
        counts = space_counts(left, right, space)
    else:
        if n_left is None or n_right is None:
            n_left, n_right = row_counts(left, right)
        counts = {0: (n_left, n_right)} if n_left > 0 and n_right > 0 else {}
    if not counts:
        return spark.createDataFrame([], CAND_SCHEMA)
    if block is None:
        first = right.select(F.size(vec).alias("d")).first()
        sizes = choose_blocks(counts, default_parallelism(spark), first["d"] if first else 1)
    else:
        sizes = {s: block for s in counts}
    blocks = {s: (-(-n // sizes[s]), -(-m // sizes[s])) for s, (n, m) in counts.items()}
    if space is None:
        (grid, (q, t)) = (None, (F.lit(b).cast("bigint") for b in blocks[0]))
    else:
        grid = spark.createDataFrame([(s, *b) for s, b in blocks.items()], "_space bigint, _q bigint, _t bigint")
        q, t = F.col("_q"), F.col("_t")
    lrep = _prepare(left, left_id, vec, left_bias, left_emit, space, grid, "lblk", "rblk", q, t)
    rrep = _prepare(right, right_id, vec, right_bias, None, space, grid, "rblk", "lblk", t, q)
    kernel = _kernel_factory(int(k), float(alpha), tuple(sides))
    return (lrep.groupBy("space", "lblk", "rblk")
                .cogroup(rrep.groupBy("space", "lblk", "rblk"))
                .applyInArrow(kernel, CAND_SCHEMA))


def choose_blocks(counts: dict[int, tuple[int, int]], parallelism: int, dim: int = 64) -> dict[int, int]:
    """Block rows of every space: the tasks are dealt by the spaces' numbers of scores."""
    total = sum(n * m for n, m in counts.values())
    return {s: choose_block(n, m, max(1, math.ceil(parallelism * n * m / max(1, total))), dim) for s, (n, m) in counts.items()}


def space_counts(left: DataFrame, right: DataFrame, space: str) -> dict[int, tuple[int, int]]:
    """Rows of both tables by space, for the spaces that both have (a row a space, in one job)."""
    sides = [df.groupBy(F.col(space).cast("bigint").alias("_space")).count().withColumn("side", F.lit(i))
             for i, df in enumerate((left, right))]
    found: dict[int, list[int]] = {}
    for r in sides[0].unionByName(sides[1]).where("_space is not null").collect():
        found.setdefault(r["_space"], [0, 0])[r["side"]] = r["count"]
    return {s: (n, m) for s, (n, m) in sorted(found.items()) if n and m}


def row_counts(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Rows of both tables in one small job."""
    rows = (left.agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(0))
            .unionByName(right.agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(1))).collect())
    got = {r["s"]: r["n"] for r in rows}
    return got[0], got[1]


def final_both(cands: DataFrame, k: int) -> DataFrame:
    """Merge the partial candidates of both sides at once: ``(space, right_side, key, other, score, rank)``."""
    w = Window.partitionBy("space", "right_side", "key").orderBy(F.col("score").desc(), F.col("other").asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def final_topk(cands: DataFrame, k: int, side: str) -> DataFrame:
    """Merge the partial candidates of one side: ``(space, key, other, score, rank)``."""
    w = Window.partitionBy("space", "key").orderBy(F.col("score").desc(), F.col("other").asc())
    return (cands.where(F.col("right_side") == F.lit(side == "right"))
                 .select("space", "key", "other", "score")
                 .withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k))


def topk(left: DataFrame, right: DataFrame, k: int, **kw) -> DataFrame:
    """Top-k right rows per left row: ``(space, l_idx, r_idx, score, rank)``."""
    c = block_candidates(left, right, k, sides=("left",), **kw)
    return (final_topk(c, k, "left")
            .select("space", F.col("key").alias("l_idx"), F.col("other").alias("r_idx"),
                    "score", F.col("rank").cast("int").alias("rank")))
