"""SimHash links and components against comparing all fingerprints."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lexalign.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=2):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return dict(zip(ids, label))


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(df, **kw).collect()}
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], fps)
    assert {i: got[i][0] for i in got} == {r[0]: f for r, f in zip(rows, fps)}
    assert {i: got[i][1] for i in got} == want


def test_components_of_edge_cases(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = [(0, None, "x"), (1, "", None), (2, " \n\t", "x"), (3, "Ä ä", "x"), (4, "One two", "x"), (5, "one\x0btwo", "x"),
            (6, "one two three", "x"), (7, "ONE TWO THREE", "x"), (8, "a\xa0b c d", "x"), (9, "z " * 50_000, "x")]
    for i in range(10, 90):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words), "x"))
    check(spark, rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "p q r s"), (None, None), (7, "a b c d"), (7, "a b c d")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (7, 7), (7, 7)]
    kept = simhash.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["7", "None", "None"]


@pytest.mark.parametrize("bucket_rows", [4, 10_000])
def test_hot_buckets_lose_no_link(spark, bucket_rows):
    """A dense cloud of fingerprints around one base, with small buckets forced and without."""
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 400:
        x = int(rng.choice(list(fps)))
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    groups = spark.createDataFrame([(f, f) for f in signed], "fp long, rep long")
    links = simhash.near_links(groups, 2, bucket_rows).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 64 for r in links)
    roots = {r.node: r.root for r in simhash.connected_components(
        spark.createDataFrame(links or [], "a long, b long")).collect()}
    assert {f: roots.get(f, f) for f in signed} == brute_components(
        sorted(signed), [f & (1 << 64) - 1 for f in sorted(signed)])


def test_links_by_masks():
    rng = np.random.default_rng(9)
    fp = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64))
    a, b = simhash.link_by_masks(fp, 2)
    label = {int(f): int(f) for f in fp}
    index = {int(f): i for i, f in enumerate(fp)}
    got = simhash.forest(len(fp), np.array([index[int(x)] for x in a]), np.array([index[int(x)] for x in b]))
    want = brute_components(list(label), list(label))
    assert {int(f): int(fp[g]) for f, g in zip(fp, got)} == want
