"""Shards against a plain reading of the bids, their files, and what moves when shards come, go or change weight."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexalign.llm import sharding

SCHEMA = "doc_id long, text string, shard string, _at string, extra int"


def plain(key, weights, names=None):
    names = names or [str(i) for i in range(len(weights))]
    bids = []
    for i, (name, w) in enumerate(zip(names, weights)):
        h = int(hashlib.md5(f"{'' if key is None else key}@{name}".encode()).hexdigest()[:13], 16)
        bids.append((w / -math.log((h + 0.5) / 2**52), -i))
    return -max(bids)[1]


def test_bids_weights_and_moves(spark):
    weights, n = [1.0, 2.0, 0.5, 1.0], 4000
    key = F.col("id").cast("string")
    df = spark.range(n).select("id", sharding.shard_of(key, weights).alias("a"), sharding.shard_of(key, weights + [1.5]).alias("b"),
                               sharding.shard_of(key, weights[:2] + [2.0, 1.0]).alias("c"),
                               sharding.shard_of(key, [1.0, 0.5, 1.0], ["0", "2", "3"]).alias("d"))
    rows = df.collect()
    assert [r.a for r in rows] == [plain(r.id, weights) for r in rows]
    share = Counter(r.a for r in rows)
    assert all(abs(share[i] - n * w / 4.5) < 5 * math.sqrt(n) for i, w in enumerate(weights))
    assert all(r.a == r.b or r.b == 4 for r in rows) and abs(sum(r.b == 4 for r in rows) - n / 4) < 200
    assert all(r.a == r.c or r.c == 2 for r in rows)                         # a heavier shard only takes
    assert all(r.d == {0: 0, 2: 1, 3: 2}[r.a] for r in rows if r.a != 1)     # a shard that goes only gives
    for bad in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit("x"), bad)


def test_files_hold_every_record_once(spark):
    rows = [(i % 700, f"text {i % 50} é" * (i % 7), "s", "x", i) for i in range(900)]
    rows += [(None, t, None, None, i) for i, t in enumerate([None, "", "a", "a"] * 60)]     # no key
    rows += [(77, "hot", "s", "x", 5)] * 500                                                # one row again and again
    rows += [(2000, "long " * 400_000, "s", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    path = sharding.write_shards(docs, [1.0] * 5, [1.0] * 6)
    schema = "doc_id long, text string, extra int, grown_shard int, _range int, _at long, shard int"
    got = sharding.read_shards(spark, path, schema).collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in got) == Counter((r[0], r[1], r[4]) for r in rows)
    assert all(r.shard == plain(r.doc_id, [1.0] * 5) and r.grown_shard == plain(r.doc_id, [1.0] * 6) for r in got)
    for shard in range(5):
        inside = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in inside] == list(range(len(inside)))
        keys = [-1 if r.doc_id is None else r.doc_id for r in inside]
        assert keys == sorted(keys)


def test_query_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "é", "en", "s", 1), (None, None, None, None, None), (4, "", "en", "s", 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = {r.doc_id: r for r in sharding.op12_sharding(spark, f"{tmp_path}/a").collect()}
    assert got[3].size == 3 and got[3].text_crc32 == zlib.crc32("é".encode()) and got[None].size == 1 and got[None].text_crc32 == 0
    assert all(r.law == "key" and r.slot >= 0 for r in got.values())
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert sharding.op12_sharding(spark, f"{tmp_path}/b").collect() == []
