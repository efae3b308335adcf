"""The pipeline's stages on planted documents, and the rules of the stage list."""

import numpy as np

import corpus_pipeline
from lexalign.llm import quality_rules, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(["ta", "ri", "lo", "men", "sa", "ku"], int(rng.integers(1, 4)))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(words, n))
    rows = [(i, text(int(rng.integers(60, 300))), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    passage = text(30)
    near = text(250).split(" ")
    rows += [(200 + i, text(40) + " " + passage + " " + text(40), "en", "p") for i in range(5)]
    rows += [(300 + i, rows[4][1], "en", "copy") for i in range(6)]
    rows += [(400 + i, " ".join(near[:i] + ["oddword"] + near[i + 1:]), "en", "near") for i in range(3)]
    rows += [(500 + i, " ".join(w.upper() + "%%%" for w in text(120).split()), "en", "junk") for i in range(4)]
    rows += [(600, "short text", "en", "junk"), (601, None, "en", "junk"), (602, "same " * 300, "en", "junk")]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    columns, seen = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], "")
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in seen]
    junk = {*range(500, 504), 600, 601, 602}
    assert not junk & set(ids[1]) and len(ids[1]) >= 0.97 * (len(rows) - len(junk))
    assert not set(range(300, 306)) & set(ids[2]) and 4 in ids[2]        # copies of document 4 are gone
    texts = {r.doc_id: r.text for r in seen[3].collect()}
    assert set(texts) == set(ids[2])
    holders = [i for i in range(200, 205) if i in texts]
    assert passage[:60] in texts[holders[0]] and all(passage[10:-10] not in texts[i] for i in holders[1:])
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    assert set(ids[4]) == set(ids[3]) and len(ids[4]) >= len(ids[3])     # every document once at least
    used = {}
    for r in seen[5].collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= 2048
    assert set(ids[5]) == set(ids[4])


def test_null_and_shared_ids_get_their_own_verdicts(spark):
    rows, passage = corpus()
    clean = [r for r in rows if r[0] < 200]
    junk = " ".join(w.upper() + "%%%" for w in clean[150][1].split())
    odd = [(None, "short", "en", "junk"), (None, junk, "en", "junk"), (7, junk, "en", "shared"), (7, None, "en", "shared")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in clean + odd], SCHEMA)
    good, one, cut = [stage for _, stage in corpus_pipeline.STAGES[:3]]
    left = [(r.doc_id, r.text) for r in good(spark, docs, "").collect()]
    assert not {(r[0], r[1]) for r in odd} & set(left) and (7, clean[7][1]) in left

    near = clean[0][1].split(" ")
    copies = [(None, " ".join(["oddword"] + near), "en", "near"), (None, clean[1][1], "en", "copy"), (None, clean[1][1], "en", "copy"),
              (5, clean[6][1] + " and a different end of it " + clean[150][1], "en", "shared")]
    alone = [(None, clean[160][1], "en", "null"), (None, clean[160][1], "fr", "null")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in clean[:150] + copies + alone], SCHEMA)
    left = [(r.doc_id, r.text) for r in one(spark, docs, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(r[0], r[1]) for r in clean[:150] + copies[3:] + alone[:1]]))

    head, tail = clean[0][1] + " " + passage, "a rest that nobody has"
    rows = [(1, head, "en", "x"), (None, passage + tail, "en", "x"), (9, "zz" + passage, "en", "x"), (9, tail, "en", "x"), (9, None, "en", "x")]
    got = {(r.doc_id, r.text, r.n_chars) for r in cut(spark, spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA), "").collect()}
    assert got == {(1, head, len(head)), (None, tail, len(tail)), (9, "zz", 2), (9, tail, len(tail)), (9, None, 0)}


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_dedup", "suffix_dedup", "mix_sources", "pack"]
    assert quality_rules.LOWER > 0 and suffix_dedup.LENGTH == 50


def test_empty_table(spark):
    out = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
    assert out.collect() == []
