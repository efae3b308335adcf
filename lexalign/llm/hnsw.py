"""Nearest neighbours with one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt into shards of about ``SHARD_ROWS`` by a hash. Each
shard is one row of the index table: its vectors, the ids of each, and its graph
as flat neighbour arrays (``-1`` pads), one block of ``M0`` slots a node on the
ground level and ``M`` on each level above. A node's candidates are its
``EF_BUILD`` nearest predecessors in a random insertion order, found exactly by
blocked matrix products: what the insertions of the incremental algorithm look for.
Neighbours are chosen by the diversity heuristic, and reverse links are shrunk by
it. Queries go to every shard in blocks, all queries of a block walk together,
and the shard results are merged by exact double-precision distance. A graph works on single-precision copies that
were scaled, centred on the shard's median and scaled again, so large or shifted vectors keep their differences.

Equal vectors are one node that carries its ``k + 1`` smallest ids, which are all
that can be among the ``k`` nearest; so large groups of copies neither fill
neighbour lists nor one task. Memory is bounded by a shard plus a query block.

Defined results: rows whose id is null, or whose vector is null, empty, zero or
holds null or non-finite components take no part. Vectors are compared with
those of equal length only. Repeated rows count once. If one id has several vectors,
each is a candidate of that id, the best one counts, and as a query the smallest
vector is used. Ties go to the smaller id. With fewer candidates than ``k``, or an
empty table, all there are come back. Other columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexalign.llm.common import arrow_rows, table, written

M = 16
M0 = 32
EF_BUILD = 64
EF_SEARCH = 128
SHARD_ROWS = 1 << 16
QUERY_BLOCK = 1024
#: Queries of one co-group: the copies of a shard are one for so many queries.
QUERY_GROUP = 1 << 16


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of ``a`` (q, d) and their own candidates ``b`` (q, c, d)."""
    diff = b - a[:, None, :]
    return np.einsum("qcd,qcd->qc", diff, diff)


def _select(v: np.ndarray, node: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node from its candidates (q, c), nearest first, ``-1`` pads.

    A candidate is taken if it is nearer to the node than to all taken ones; free
    slots are then filled with the nearest of those left out.
    """
    q, c = cand.shape
    out = np.full((q, most), -1, dtype=np.int32)
    for at in range(0, q, 256):
        own, ids = v[node[at:at + 256]], cand[at:at + 256]
        vec = v[np.maximum(ids, 0)]
        dist = np.where(ids >= 0, _distances(own, vec), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        vec = np.take_along_axis(vec, order[:, :, None], 1)
        norm = np.einsum("qcd,qcd->qc", vec, vec)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (vec @ vec.transpose(0, 2, 1))
        shadowed = ~np.isfinite(dist)
        taken = np.zeros(ids.shape, dtype=bool)
        count = np.zeros(len(ids), dtype=np.int64)
        for r in range(c):
            take = ~shadowed[:, r] & (count < most)
            taken[:, r] = take
            count += take
            shadowed |= take[:, None] & (between[:, r, :] < dist)
        rank = np.where(taken, 0, 1) + np.where(np.isfinite(dist), 0, 2)
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        picked = np.where(np.take_along_axis(np.isfinite(dist), best, 1), np.take_along_axis(ids, best, 1), -1)
        out[at:at + 256, :picked.shape[1]] = picked
    return out


def _level_graph(v: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array (len(nodes), most) of one level; ``nodes`` in insertion order."""
    n = len(nodes)
    x = v[nodes]
    norm = np.einsum("nd,nd->n", x, x)
    chosen = np.full((n, most), -1, dtype=np.int32)
    for at in range(0, n, 256):
        end = min(n, at + 256)
        dist = norm[at:end, None] + norm[None, :end] - 2 * (x[at:end] @ x[:end].T)
        dist[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = np.inf
        ef = min(EF_BUILD, end)
        cand = np.argpartition(dist, ef - 1, axis=1)[:, :ef]
        cand = np.where(np.isfinite(np.take_along_axis(dist, cand, 1)), cand, -1)
        chosen[at:end] = _select(x, np.arange(at, end), cand, most)
    src = np.repeat(np.arange(n), most)
    dst = chosen.ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    both = np.unique(np.concatenate([src * n + dst, dst * n + src])) if n else np.zeros(0, dtype=np.int64)
    src, dst = both // max(1, n), both % max(1, n)
    first = np.searchsorted(src, np.arange(n))
    degree = np.bincount(src, minlength=n)
    out = np.full((n, most), -1, dtype=np.int32)
    few = degree[src] <= most
    out[src[few], (np.arange(len(src)) - first[src])[few]] = dst[few]
    for width in sorted({1 << int(d - 1).bit_length() for d in degree[degree > most]}):
        many = np.flatnonzero((degree > max(most, width // 2)) & (degree <= width))
        for at in range(0, len(many), max(1, (1 << 22) // (width * width))):
            some = many[at:at + max(1, (1 << 22) // (width * width))]
            slot = first[some][:, None] + np.arange(width)[None, :]
            cand = np.where(np.arange(width)[None, :] < degree[some][:, None], dst[np.minimum(slot, len(dst) - 1)], -1)
            out[some] = _select(x, some, cand, most)
    return out


class _Frame:
    """Maps a shard's vectors, and queries to it, to single precision about zero and about one in size."""

    def __init__(self, vectors: np.ndarray):
        v = np.asarray(vectors, dtype=np.float64)
        self.first = _power_of_two(v)
        # the median: large rows do not move it away from many small ones, whose differences would be lost beside it
        self.middle = np.median(v / self.first, axis=0) if len(v) else 0.0
        self.second = _power_of_two(v / self.first - self.middle)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        moved = (np.asarray(vectors, dtype=np.float64) / self.first - self.middle) / self.second
        # a query far outside the shard keeps its direction; its distances need not be exact here
        return np.ascontiguousarray(np.clip(moved, -1e15, 1e15), dtype=np.float32)


def _power_of_two(v: np.ndarray) -> float:
    most = float(np.abs(v).max(initial=0.0))
    return float(2.0 ** np.clip(np.ceil(np.log2(most)), -1000, 1000)) if most > 0 else 1.0


class Graph:
    """A shard's graph: level 0 for all nodes and, above, node lists with their own flat neighbour arrays."""

    def __init__(self, vectors: np.ndarray, ground: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]]):
        self.frame = _Frame(vectors)
        self.v, self.ground, self.upper = self.frame(vectors), ground, upper
        #: Distances that the last search took, over all its queries.
        self.visited = 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        v = _Frame(vectors)(vectors)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(v))
        level = np.floor(-np.log(1 - rng.random(len(v))) / np.log(M)).astype(np.int64)

        def graph(nodes: np.ndarray, most: int) -> np.ndarray:
            found = _level_graph(v, nodes, most)
            return np.where(found >= 0, nodes[np.maximum(found, 0)], -1).astype(np.int32)

        ground = np.full((len(v), M0), -1, dtype=np.int32)
        ground[order] = graph(order, M0)
        upper = []
        for at in range(1, int(level.max(initial=0)) + 1):
            nodes = order[level[order] >= at]
            flat = graph(nodes, M)
            by_id = np.argsort(nodes)
            upper.append((nodes[by_id].astype(np.int32), flat[by_id]))
        return cls(vectors, ground, upper)

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Nodes found for each query (q, ef), ``-1`` pads; all queries walk together."""
        q = self.frame(queries)
        n = len(self.v)
        entry = self.upper[-1][0][0] if self.upper else 0
        now = np.full(len(q), entry, dtype=np.int64)
        best = _distances(q, self.v[now][:, None, :])[:, 0]
        for nodes, flat in reversed(self.upper):
            moving = np.arange(len(q))
            while len(moving):
                near = flat[np.searchsorted(nodes, now[moving])]
                dist = np.where(near >= 0, _distances(q[moving], self.v[np.maximum(near, 0)]), np.inf)
                pick = dist.argmin(axis=1)
                low = dist[np.arange(len(moving)), pick]
                better = low < best[moving]
                moving = moving[better]
                now[moving], best[moving] = near[better, pick[better]], low[better]
        ids = np.full((len(q), ef), -1, dtype=np.int64)
        dist = np.full((len(q), ef), np.inf, dtype=np.float32)
        opened = np.zeros((len(q), ef), dtype=bool)
        seen = np.zeros((len(q), n), dtype=bool)
        ids[:, 0], dist[:, 0] = now, best
        seen[np.arange(len(q)), now] = True
        live = np.arange(len(q))
        while len(live):
            waiting = np.where(opened[live], np.inf, dist[live])
            pick = waiting.argmin(axis=1)
            open_ = np.isfinite(waiting[np.arange(len(live)), pick])
            live, pick = live[open_], pick[open_]
            if not len(live):
                break
            opened[live, pick] = True
            near = self.ground[ids[live, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            far = np.full(near.shape, np.inf, dtype=np.float32)
            diff = self.v[near[r, c]] - q[live[r]]
            far[r, c] = np.einsum("nd,nd->n", diff, diff)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_dist = np.concatenate([dist[live], far], axis=1)
            all_open = np.concatenate([opened[live], np.zeros(near.shape, dtype=bool)], axis=1)
            best_ = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best_, 1)
            dist[live] = np.take_along_axis(all_dist, best_, 1)
            opened[live] = np.take_along_axis(all_open, best_, 1)
        self.visited = int(seen.sum())
        return ids


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    inf = F.lit(float("inf"))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0.0))


INDEX_SCHEMA = ("dim int, shard long, ids array<long>, id_ends array<int>, vectors binary, ground binary, "
                "level_sizes array<int>, level_nodes binary, level_neighbours binary")


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = (k.as_py() for k in key)
    ids = rows.column("ids").combine_chunks()
    v = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    g = Graph.build(v, seed=shard)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()),
        "ids": pa.array([ids.flatten().to_pylist()], pa.list_(pa.int64())),
        "id_ends": pa.array([np.cumsum(ids.value_lengths().to_numpy()).tolist()], pa.list_(pa.int32())),
        "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()),
        "ground": pa.array([g.ground.astype("<i4").tobytes()], pa.binary()),
        "level_sizes": pa.array([[len(nodes) for nodes, _ in g.upper]], pa.list_(pa.int32())),
        "level_nodes": pa.array([b"".join(nodes.astype("<i4").tobytes() for nodes, _ in g.upper)], pa.binary()),
        "level_neighbours": pa.array([b"".join(flat.astype("<i4").tobytes() for _, flat in g.upper)], pa.binary()),
    })


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index table, one row a shard, and the number of shards."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vec_col)
    same = Window.partitionBy("v").orderBy("vec_id")
    nodes = written(
        rows.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "hnsw-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "ids", "v")
    with arrow_rows(spark, 4):
        index = written(dealt.groupBy("dim", "shard").applyInArrow(_build_shard, INDEX_SCHEMA), "hnsw-index")
    return index, shards


def _load(row: dict) -> tuple[Graph, np.ndarray, list[np.ndarray]]:
    dim = row["dim"]
    v = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, dim)
    ground = np.frombuffer(row["ground"], dtype="<i4").reshape(-1, M0)
    sizes = row["level_sizes"]
    cuts = np.cumsum(sizes)[:-1] if sizes else []
    nodes = np.split(np.frombuffer(row["level_nodes"], dtype="<i4"), cuts) if sizes else []
    flat = np.split(np.frombuffer(row["level_neighbours"], dtype="<i4").reshape(-1, M), cuts) if sizes else []
    ids = np.split(np.array(row["ids"], dtype=np.int64), row["id_ends"][:-1])
    return Graph(v, ground, list(zip(nodes, flat))), v, ids


FOUND_SCHEMA = "query_id long, vec_id long, score double"


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query ``(vec_id, v)``."""
    spark = index.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    asked = asked.select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def walk(shard: pa.Table, block: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if shard.num_rows and block.num_rows:
            graph, v, ids = _load(shard.slice(0, 1).to_pylist()[0])
            qid = block.column("query_id").to_numpy()
            qv = block.column("v").combine_chunks().flatten().to_numpy().reshape(len(qid), -1)
            for at in range(0, len(qid), QUERY_BLOCK):
                found = graph.search(qv[at:at + QUERY_BLOCK], ef)
                for i, nodes in enumerate(found, at):
                    nodes = nodes[nodes >= 0]
                    score = np.sqrt(((v[nodes] - qv[i]) ** 2).sum(axis=1))
                    best = {}
                    for s, node in sorted(zip(score.tolist(), nodes.tolist())):
                        if len(best) >= k and s > most:
                            break
                        for other in ids[node].tolist():
                            if other != qid[i]:
                                best.setdefault(other, s)
                        most = s
                    top = sorted((s, o) for o, s in best.items())[:k]
                    out_q += [int(qid[i])] * len(top)
                    out_v += [o for _, o in top]
                    out_s += [s for s, _ in top]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})

    keys = ["dim", "shard", "part"]
    with arrow_rows(spark, 512):
        found = written(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(walk, FOUND_SCHEMA), "hnsw-found")
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    index, shards = build_index(vectors, 10)
    queries = _usable(vectors, "vec_id", "embedding").where("vec_id % 100 = 0")
    return search_index(index, shards, queries, 10)
