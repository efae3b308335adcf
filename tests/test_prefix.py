"""The walk over sorted words against brute force: borders of ranges, long words, many spaces."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexalign.operators import oov
from lexalign.operators.prefix import prefix_search


def brute(requests, vocabulary):
    out = {}
    for space, word in set(requests):
        if not word or word in vocabulary.get(space, {}):
            continue
        mine = vocabulary.get(space, {})
        short = max((v for v in mine if word.startswith(v)), key=len, default=None)
        longer = min(((len(v), i) for v, i in mine.items() if v.startswith(word)), default=None)
        if short is not None or longer:
            out[space, word] = (mine[short] if short else None, len(short) if short else None, longer[1] if longer else None)
    return out


def run(spark, requests, vocabulary, ranges):
    rows = [(s, w, i) for s, words in vocabulary.items() for w, i in words.items()]
    got = prefix_search(spark.createDataFrame(requests, "space bigint, word string"),
                        spark.createDataFrame(rows, "space bigint, word string, idx bigint"), ranges).collect()
    out = {(r.space, r.word): (r.short_idx, r.short_len, r.long_idx) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_against_brute_force(spark, ranges):
    rng = random.Random(ranges)
    vocabulary, requests = {}, []
    for space in (0, 1, 5):
        words = {"".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
        words = sorted(words, key=lambda w: rng.random())
        vocabulary[space] = {w: i for i, w in enumerate(words[:90])}
        requests += [(space, w) for w in words[60:]] + [(space, w[:rng.randrange(1, 4)]) for w in words[:40]]
    requests += requests[:30] + [(9, "abc"), (0, None), (0, "")]
    assert run(spark, requests, vocabulary, ranges) == brute(requests, vocabulary)


@pytest.mark.parametrize("ranges", [2, 11])
def test_one_word_is_open_over_many_ranges(spark, ranges):
    vocabulary = {0: {"a": 7, "ab": 3, **{f"abc{i:04d}{'x' * (i % 5)}": 100 + i for i in range(400)}, "b": 1}}
    requests = [(0, w) for w in ("abc", "abc0", "abc03", "ab0", "abcz", "abc0399xxxxy", "zz", "abc0200x", "aa")]
    assert run(spark, requests, vocabulary, ranges) == brute(requests, vocabulary)


def test_a_word_of_a_million_characters(spark):
    long = "xy" * 500_000
    vocabulary = {0: {"x": 0, "xy" * 1000: 1, long + "z": 2, long[:-1] + "q": 3}}
    requests = [(0, long), (0, "xyx"), (0, long + "zz")]
    assert run(spark, requests, vocabulary, 3) == brute(requests, vocabulary)


def test_extension_by_space_is_that_of_each(spark):
    rng = random.Random(4)
    emb, asked = [], []
    for space in (0, 3):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)}, key=lambda w: rng.random())
        emb += [(space, i, w, [float(i), float(len(w))]) for i, w in enumerate(words[:30])]
        asked += [(space, w, "x") for w in words[20:]]
    e = spark.createDataFrame(emb, "space bigint, idx bigint, word string, vec array<double>")
    d = spark.createDataFrame(asked, "space bigint, src_word string, trg_word string")
    got = sorted(tuple(r) for r in oov.extend_with_prefix([d], e).select("space", "idx", "word", "vec").collect())
    want = []
    for s in (0, 3):
        one = oov.extend_with_prefix([d.where(f"space = {s}").drop("space")], e.where(f"space = {s}").drop("space"))
        want += [(s, *r) for r in one.select("idx", "word", "vec").collect()]
    assert got == sorted(want)
    nothing = oov.extend_with_prefix([d.limit(0)], e)
    assert sorted(tuple(r) for r in nothing.select("space", "idx", "word").collect()) == sorted((s, i, w) for s, i, w, _ in emb)


def test_words_without_a_match_are_spread(spark):
    """A null id is one key of the join: all its words, with vectors, met in one task."""
    from lexalign.operators import oov
    emb = spark.createDataFrame([(i, chr(97 + i), [float(i)]) for i in range(26)], "idx long, word string, vec array<double>")
    words = spark.createDataFrame([(f"{chr(97 + i % 26)}{i}",) for i in range(2600)], "word string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        got = oov.prefix_embeddings(words, emb).select("word", "vec", "long_word", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 2600 and all(r.vec == [float(ord(r.word[0]) - 97)] and r.long_word is None for r in got)
    assert max(Counter(r.p for r in got).values()) < 1300


def test_ranges_follow_the_rows(spark, monkeypatch):
    from lexalign.functions import ranking
    df = spark.range(1000).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(10**6)))
    want = [r.id for r in df.orderBy("key", "id").collect()]
    monkeypatch.setattr(ranking, "RANGE_ROWS", 10)
    assert ranking.range_count(df) == 100
    got = ranking.row_number_global(df, [F.col("key").asc(), F.col("id").asc()])
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.row_no)] == want
