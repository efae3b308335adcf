"""Cached encoding, counts and token files against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexalign.llm import token_count, token_files
from lexalign.llm.tokens import default_path, encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ALPHABET = "abTHE zß éÉ.,!'#|<>09\n\t\r\x0b\x1c\x85\xa0́İΣ中\U0001f600  "
PIECE = st.one_of(st.text(ALPHABET, max_size=12), st.sampled_from(
    ["<|endoftext|>", "<|startoftext|>", " don't", "THE'S", "\n\n", "   ", "µ÷×", "Straße", "100,000.5"]), st.text(max_size=4))


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=120, deadline=None)
@given(parts=st.lists(PIECE, max_size=12))
def test_ids_are_those_of_the_library(name, parts):
    text = "".join(parts)
    path = default_path(name)
    want = library(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(path).ids(text), "<u4").tolist() == want


_LIBRARY = {}


def library(path):
    return _LIBRARY.setdefault(path, Tokenizer.from_file(path))


ROWS = [(5, "The quick brown fox", "x"), (1, None, "x"), (2, "", None), (None, "null id", "x"),
        (9, "wörd " * 30_000, "x"), (5, "The quick brown fox", "x"), (7, "#$% <|endoftext|> ok", "x"), (-3, "x\n\ny", "x")]
SCHEMA = "doc_id long, text string, ids string"


@pytest.mark.parametrize("name", FILES)
def test_counts(spark, name):
    path = default_path(name)
    got = token_count.count_tokens(spark.createDataFrame(ROWS, SCHEMA), path).collect()
    want = [(i, len((t or "").encode()), n := len(library(path).encode(t or "", add_special_tokens=False).ids), n > 2048)
            for i, t, _ in ROWS]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA), path).collect() == []


def test_summary_keeps_all_frequent_items():
    rng = np.random.default_rng(0)
    stream = [str(x) for x in rng.zipf(1.3, 60_000) % 50_000]
    seen = token_count.Summary(size=600)
    for i in range(0, len(stream), 1000):
        seen.add(stream[i:i + 1000])
    assert len(seen.counts) <= 600 + 1000
    want = {k for k in set(stream) if stream.count(k) >= len(stream) / 100} if len(stream) < 10_000 else \
        {k for k, v in __import__("collections").Counter(stream).items() if v >= len(stream) / 100}
    assert want <= {k for k, _ in seen.frequent(1 / 100)}


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=70))
def test_values_round_trip(values):
    v = np.array(values, dtype="<u4")
    control, data = token_files.encode_values(v)
    assert len(control) == -(-len(v) // 4)
    assert token_files.decode_values(control, data, len(v)).tolist() == values


def test_files_round_trip(spark, monkeypatch):
    path = default_path(FILES[0])
    files = token_files.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path, 1)
    got = token_files.read_token_files(*files).collect()
    want, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(path).encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got) \
        == [(s, i, n, ids) for i, s, n, ids in want]
    digests = token_files._read(*files, keep_ids=False).collect()
    assert sorted((r.start, r.ids_crc32) for r in digests) \
        == [(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, _, ids in want]
    ranks = files[1].orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)


def test_empty_files(spark):
    files = token_files.write_token_files(spark.createDataFrame([], SCHEMA), default_path(FILES[0]), 1)
    assert token_files.read_token_files(*files).collect() == []
