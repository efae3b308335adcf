"""Packing: whole, gapless, certified."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexalign.llm import packing
from lexalign.llm.tokens import default_path

PATH = default_path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60))
def test_bins_hold_and_the_bound_is_one(lengths):
    lengths = np.array(lengths)
    bins, offsets, used = packing.best_fit_decreasing(lengths)
    assert packing.lower_bound(lengths) <= used <= len(lengths)
    for b in range(used):
        inside = sorted(zip(offsets[bins == b], lengths[bins == b]))
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()
        assert sum(n for _, n in inside) <= packing.SIZE


def test_bound_knows_items_over_a_half():
    assert packing.lower_bound(np.full(10, 1100)) == 10
    assert packing.lower_bound(np.full(9, 683)) == 5


def check(rows, got):
    want = []
    tok = Tokenizer.from_file(PATH)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                 for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        inside.sort()
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()
        assert sum(n for _, n in inside) <= 2048
    return len(places), packing.lower_bound(np.array([w[3] for w in want]))


def test_documents(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "word " * int(rng.integers(1, 1800))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "long " * 9000), (203, "same"), (203, "same")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    used, bound = check(rows, packing.pack_documents(df, PATH, 0).collect())
    assert used <= bound * 1.01 + 1
    used, bound = check(rows, packing.pack_documents(df, PATH, 0, part_rows=40).collect())
    assert used <= bound + -(-len(rows) // 40)          # each partition may round up to a bin of its own
    assert packing.pack_documents(df.where("doc_id = -1"), PATH, 0).collect() == []


def placed(rows, lengths):
    """Sequences in use, after a look that they are gapless and hold what they can."""
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence, []).append((r.offset, int(lengths[r.uid])))
    for inside in fill.values():
        inside.sort()
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()
        assert sum(n for _, n in inside) <= 2048
    return len(fill)


@pytest.mark.parametrize("part_rows", [50, 1000])
def test_exchange_saves_bins(spark, part_rows):
    rng = np.random.default_rng(4)
    lengths = rng.integers(400, 1100, 1000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid long, length int")
    first = placed(packing.pack(df, part_rows=part_rows, patience=0)[0].collect(), lengths)
    places, certificate = packing.pack(df, part_rows=part_rows)
    rows, stands = places.collect(), certificate.collect()
    assert sorted(r.uid for r in rows) == list(range(1000))
    used = placed(rows, lengths)
    assert used == sum(r.bins for r in stands) and all(r.bins >= r.bound for r in stands)
    assert packing.lower_bound(lengths) <= used <= first
    if part_rows == 50:
        assert used <= first - 5 and len({r.turn for r in stands}) >= 3         # more than one exchange saved bins
        assert used <= packing.best_fit_decreasing(lengths)[2] * 1.01 + 1          # nearly as one partition of all


def test_certificate_covers_all_sequences(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.integers(1, 5000)), 1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, certified int")
    packed, certificate = packing.pack_with_certificate(df, PATH, 0, part_rows=20)
    got = certificate.collect()
    assert packed.select("sequence_id").distinct().count() == sum(r.bins for r in got)
    assert all(r.certified == (r.bins == r.bound) for r in got) and any(r.kind == "whole pieces" and r.bins for r in got)
    packing.pack_documents(df, PATH, 0, str(tmp_path / "certificate"))
    one = spark.read.parquet(str(tmp_path / "certificate")).where("kind = 'partition'").collect()
    assert len(one) == 1 and one[0].bound <= one[0].bins
