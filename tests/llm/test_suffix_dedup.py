"""Removed spans against comparing all strings of 50 bytes."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lexalign.llm import suffix_dedup

SCHEMA = "doc_id long, text string, n_chars long, spans string"


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        i = float("inf") if i is None else i
        for j in range(len(b) - 49):
            least[b[j:j + 50]] = min(least.get(b[j:j + 50], float("inf")), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if least[b[j:j + 50]] < (float("inf") if i is None else i):
                gone[j:j + 50] = b"\1" * 50
        spans = [s for s in bytes(gone).split(b"\0") if s]
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def digest(rows):
    return sorted(map(str, ((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans),
                             hashlib.sha256(r.kept).hexdigest()) for r in rows)))


def corpus():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 6)))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words, n))
    passage, other = text(40), text(14)
    rows = [(i, text(int(rng.integers(1, 120)))) for i in range(60)]
    rows += [(i, text(20) + " " + passage + " " + text(20)) for i in range(60, 90)]
    rows += [(i, text(5) + passage[30:90 + i] + other + text(5)) for i in range(90, 110)]
    near = text(150).split(" ")
    for i in range(110, 130):
        some = list(near)
        some[int(rng.integers(150))] = "changed"
        rows.append((i, " ".join(some)))
    rows += [(130, None), (131, ""), (132, "a" * 400), (133, "a" * 300 + "b" + "a" * 120), (134, "ab" * 200), (135, "x\0" * 60),
             (136, "x\0" * 40), (137, "a" * 49), (None, passage), (None, "a" * 60), (5, passage), (5, passage),
             (-7, text(5) + passage[100:180] + text(5)), (138, passage + passage)]
    return rows


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 700])
def test_spans_are_those_of_all_strings(spark, monkeypatch, chunk_bytes):
    rows = corpus()
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 12)
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], SCHEMA)
    got = suffix_dedup.remove_repeats(df, chunk_bytes=chunk_bytes).collect()
    assert digest(got) == sorted(map(str, brute(rows)))
    for r in got:
        raw = next((t or "").encode() for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        if r.doc_id is not None and r.doc_id > 5:
            cut = b"".join(raw[a:b] for a, b in zip([0, *(s.start + s.length for s in r.spans)], [*(s.start for s in r.spans), len(raw)]))
            assert cut == r.kept


def in_process(rows, per_chunk, buckets):
    """The passes without Spark."""
    packer = zstandard.ZstdCompressor()
    chunks = []
    for c, at in enumerate(range(0, len(rows), per_chunk)):
        texts = [(t or "").encode() for _, t in rows[at:at + per_chunk]]
        chunks.append({"chunk": c, "doc_ids": [i for i, _ in rows[at:at + per_chunk]], "lengths": list(map(len, texts)),
                       "n_bytes": sum(map(len, texts)), "data": packer.compress(b"".join(texts))})
    found = {c["chunk"]: {} for c in chunks}
    for kinds, ask in ((0, "ask_triggers"), (2, "ask_dictionary"), (3, "ask_suffixes")):
        groups = {}
        for row in chunks:
            known = {k: found[row["chunk"]].get(k, {}) for k in range(kinds if kinds != 2 else 1)}
            c = suffix_dedup.Chunk(row, buckets, known)
            for kind, bucket, n, data in getattr(c, ask)():
                groups.setdefault((kind, bucket), []).append((row["chunk"], n, data))
        for (kind, bucket), asked in groups.items():
            chunk, n, data = zip(*asked)
            table = pa.table({"chunk": pa.array(chunk, pa.int64()), "n": pa.array(n, pa.int32()), "data": pa.array(data, pa.binary())})
            for a in suffix_dedup.answer((pa.scalar(kind), pa.scalar(bucket)), table).to_pylist():
                found[a["chunk"]].setdefault(kind, {})[bucket] = a["bits"]
    out = []
    for row in chunks:
        c = suffix_dedup.Chunk(row, buckets, {k: found[row["chunk"]].get(k, {}) for k in range(4)})
        gone = c.removed()
        for i, a, b in zip(row["doc_ids"], c.p.starts.tolist(), c.p.ends.tolist()):
            kept = c.p.text[a:b][~gone[a:b]].tobytes()
            out.append((i, b - a, int(gone[a:b].sum()), len(suffix_dedup._spans(gone[a:b])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("step, per_chunk, buckets", [(1 << 20, 1000, 1), (256, 7, 3), (64, 1000, 5), (1 << 20, 1, 4)])
def test_passes_in_process(monkeypatch, step, per_chunk, buckets):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    suffix_dedup._powers.cache_clear()
    rows = corpus()
    assert in_process(rows, per_chunk, buckets) == sorted(map(str, brute(rows)))
    suffix_dedup._powers.cache_clear()


def test_stage_keeps_rows_and_columns(spark):
    rows = [(1, "é" * 40, 40, "x"), (2, "y" + "é" * 40, 41, "x"), (3, None, None, "x"), (None, "z", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = suffix_dedup.cut_repeats(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "é" * 40, 40, "x"), (2, "y", 1, "x"), (3, None, None, "x"), (None, "z", 1, "x")]))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
