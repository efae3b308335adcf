"""Phrase counts, scores and ranks against plain Python; fingerprints that collide; odd texts."""

import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from lexalign.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, row int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_count, max_words=5, share=100, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= min_count}
        found = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in frequent.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "é", "É", "the", "The", "x y", "日本", "-", "c", "d", "e", "\x01"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        text = "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", ";", "\x0b", "? "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [("New York City is big. new york city", "en")] * 40 + [(None, "en"), ("", None), (" \t.", "de"), ("one", "it")]
    rows += [("w " * 300_000 + "end", "long"), ("ab cd, " * 3000, "long")]
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, la, "x", 1) for i, (t, la) in enumerate(rows)], SCHEMA).repartition(5)
    return {(r.lang, r["rank"]): tuple(r)[2:] for r in co.mine_collocations(df, **options).collect()}


@pytest.mark.parametrize("options", [
    {}, {"fp_bits": 9}, {"filter_bits": 16}, {"held_grams": 500}, {"max_words": 2}, {"max_words": 3, "top": 7}])
def test_against_plain_counts(spark, options):
    rows = corpus(len(options))
    want = plain(rows, 6, options.get("max_words", 5), top=options.get("top", 2000))
    got = mined(spark, rows, min_count=6, **options)
    assert len(want) > (20 if "top" in options else 60) and got == want


def test_share_of_longer_phrases(spark):
    rows = [("p q r", "en")] * 20 + [("p q", "en")] * 5 + [("q r", "en")] * 2
    df = spark.createDataFrame([(i, t, la, "x", 1) for i, (t, la) in enumerate(rows)], SCHEMA)
    for share in (50, 85, 100):
        phrases, totals = co.count_phrases(df, min_count=5)
        got = {r.phrase for r in co.score_phrases(phrases, totals, share).collect()}
        assert got == {p for p, *_ in plain(rows, 5, share=share).values()}


def test_exact_scores_beyond_64_bits(spark):
    a, big, n = 10**13 + 7, 3 * 10**14 + 11, 4 * 10**15 + 1
    phrases = spark.createDataFrame([("en", "x", 1, big), ("en", "y", 1, a + 1), ("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    rows = co.score_phrases(phrases, totals).collect()
    assert [(r.l, r.r, r.score) for r in rows] == [(big, a + 1, 1000 * a * n // (big * (a + 1)))]
    assert 1000 * a * n > 2**64 and Decimal(1000 * a * n) < Decimal(10) ** 38


def test_stretches_hash_like_the_whole():
    raw = np.frombuffer(("Ab c, d e f. " * 500).encode(), dtype=np.uint8)
    whole = co.Stretch(raw, "en")
    want = whole.grams(co.FIRST, 3, np.flatnonzero(whole.places(3)))
    got = []
    for _, part in co.stretches(raw, 100):
        s = co.Stretch(part, "en")
        got.append(s.grams(co.FIRST, 3, np.flatnonzero(s.places(3))))
    assert np.array_equal(np.concatenate(got), want) and len(set(want.tolist())) == 1
    assert b"".join(bytes(p) for _, p in co.stretches(raw, 7)) == bytes(raw)
    assert set(co.Stretch(raw, "en").grams(co.FIRST, 1, np.arange(3))) & set(co.Stretch(raw, "fr").grams(co.FIRST, 1, np.arange(3))) == set()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert co.op11_collocations(spark, str(tmp_path)).collect() == []
