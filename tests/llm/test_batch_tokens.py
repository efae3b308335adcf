"""Ids of batches against the tokenizers library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexalign.llm import batch_tokens as bt
from lexalign.llm.tokens import default_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PLAIN = "abstTHE'é  zßÉ.,!'#0987\n\t\r\x0b"
PIECE = st.one_of(
    st.text(PLAIN, max_size=14), st.text(PLAIN + "|<>\x1c\x85\xa0\x00\x7f×÷µİ中\U0001f600ÿŸ", max_size=6),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", " don't", "THE'S", "we'll've'd", "''s", " 's", "!'re", "\n\n", "   ", " \n a",
                     "Straße", "100,000.5", "l'été 'élan", "'tis", "'s's", "\n'm"]))
LIBRARY = {n: Tokenizer.from_file(default_path(n)) for n in FILES}


def ids(name, texts, **options):
    return [np.frombuffer(x, "<u4").tolist() for x in bt.BatchEncoder(default_path(name), **options).encode([t.encode() for t in texts])]


ENCODERS = {n: bt.BatchEncoder(default_path(n)) for n in FILES}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PIECE, max_size=10).map("".join), max_size=5))
def test_ids_are_those_of_the_library(name, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODERS[name].encode([t.encode() for t in texts])]
    assert got == [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_cut_safely(name, monkeypatch):
    monkeypatch.setattr(bt, "STRETCH", 40)
    texts = ["word  two   three'll \n four\n five " * 30, "x" * 300 + " y", " " * 200 + "z", "", "é " * 100, "\n" * 90, "a b" * 50]
    assert ids(name, texts) == [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert len(bt._parts(texts[0].encode())) > 5 and b"".join(bt._parts(texts[0].encode())) == texts[0].encode()


@pytest.mark.parametrize("name", FILES)
def test_a_full_cache_gives_the_same_ids(name):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdefgé"), 5)) for _ in range(400)) for _ in range(20)]
    small = bt.BatchEncoder(default_path(name), cache_bytes=60_000)
    got = [np.frombuffer(x, "<u4").tolist() for x in small.encode([t.encode() for t in texts]) + small.encode([t.encode() for t in texts])]
    assert got == 2 * [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert small.cache.held <= 30_000 and len(small.cache.young) + len(small.cache.old) < 400


def test_narrow_ids():
    enc = bt.BatchEncoder(default_path(FILES[0]))
    wide, narrow = enc.encode([b"some text", b"\xe4\xb8\xad"]), enc.encode([b"some text", b"\xe4\xb8\xad"], "<u2")
    assert [np.frombuffer(a, "<u4").tolist() for a in wide] == [np.frombuffer(b, "<u2").tolist() for b in narrow]
