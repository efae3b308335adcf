"""Recall and exactness of the graph search against all distances."""

import numpy as np

from lexalign.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, shard string"


def brute(rows, queries, k):
    out = {}
    for q, qv in queries:
        near = {}
        for i, v in rows:
            if i != q and len(v) == len(qv):
                s = float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(qv, np.float32).astype(float)) ** 2).sum()))
                near[i] = min(near.get(i, np.inf), s)
        out[q] = sorted((s, i) for i, s in near.items())[:k]
    return out


def run(spark, rows, k=10, shard_rows=300):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    index, shards = hnsw.build_index(df, k, shard_rows=shard_rows)
    asked = hnsw._usable(df, "vec_id", "embedding").where("vec_id % 100 = 0")
    got = {}
    for r in hnsw.search_index(index, shards, asked, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_over_clusters_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1000)]
    rows += [(i, rows[5][1]) for i in range(1000, 1400)]                 # a large group of copies
    got, want = run(spark, rows), brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        if {i for _, i in got[q]} == {i for _, i in want[q]}:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)
    assert [i for s, i in got[1000]] == [5] + list(range(1001, 1010))   # ties go to the smaller id


def test_rows_that_take_no_part(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
           (None, [1.0, 1.0])]
    rows = [(0, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [4.0, 6.0]), (9, [1.0, 2.0, 3.0])]
    got = run(spark, bad + rows)
    assert got == {0: [(0.0, 7), (5.0, 8)]}


def test_empty_table(spark):
    assert run(spark, []) == {}


def found_share(vectors, ef=hnsw.EF_SEARCH, k=10):
    """Recall of the walk, by exact distances, and the share of the nodes that it visits."""
    g = hnsw.Graph.build(vectors)
    asked = np.arange(0, len(vectors), max(1, len(vectors) // 60))
    hits = 0
    for i, nodes in zip(asked, g.search(vectors[asked], ef)):
        away = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1) if np.abs(vectors).max() < 1e100 else
                       ((vectors / 1e200 - vectors[i] / 1e200) ** 2).sum(axis=1))
        nodes = nodes[nodes >= 0]
        hits += int((np.sort(away[nodes])[:k] <= np.sort(away)[:k]).sum())         # ties are as good as each other
    return hits / (k * len(asked)), g.visited / len(asked) / len(vectors)


def test_large_and_shifted_vectors_keep_their_neighbours():
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(1500, 24))
    clustered = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] + 0.1 * rng.normal(size=(1500, 24))
    for v in (plain, plain + 1e4, plain * 1e25, plain * 1e-30 + 1e-26, plain * 1e300, clustered, clustered - 1e6,
              np.cumsum(np.full((1500, 1), 0.5), axis=0) * np.ones((1, 3))):
        assert found_share(v)[0] >= 0.95
    mixed = plain * 10.0 ** rng.integers(-3, 4, (1500, 1))
    assert found_share(mixed)[0] >= 0.9                                   # small vectors are near all large ones: the hardest case


def test_a_walk_visits_a_small_part_of_a_large_shard():
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(60, 16)) * 2)[rng.integers(0, 60, 12_000)] + 0.5 * rng.normal(size=(12_000, 16))
    recall, visited = found_share(v)
    assert recall >= 0.97 and visited < 0.06
