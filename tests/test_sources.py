"""Sources, sinks, edge cases and streaming."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import oov
from lexalign.sources import dictionaries as DS
from lexalign.sources import vectext


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="lexalign-test-", dir="/tmp")


def test_vec_cap_fold_bypass_and_duplicates(spark, scratch):
    p = _write(os.path.join(scratch, "a.vec"),
               "5 2\nThe 1 0\nthe 0 1\nA 1 1\na 2 2\ncat 0 0\n")
    capped = vectext.read(spark, p, max_voc=3).orderBy("idx").collect()
    assert [r["word"] for r in capped] == ["the", "a", "cat"]
    assert list(capped[0]["vec"]) == [1.0, 0.0]          # first spelling's vector
    bypass = vectext.read(spark, p, max_voc=10, legacy_bypass=True).orderBy("idx").collect()
    assert [r["word"] for r in bypass] == ["The", "the", "A", "a", "cat"]   # cap dropped, no folding
    folded = vectext.read(spark, p, max_voc=10).collect()
    assert len(folded) == 3                              # the cap folds at any number of rows
    thr = vectext.read(spark, p, threshold=2).collect()
    assert len(thr) == 2


def test_vec_rejects_wrong_dimension(spark, scratch):
    p = _write(os.path.join(scratch, "b.vec"), "2 3\nx 1 2 3\ny 1 2\n")
    with pytest.raises(Exception):
        vectext.read(spark, p).collect()


def test_dictionary_unicode_whitespace_and_strictness(spark, scratch):
    p = _write(os.path.join(scratch, "d.txt"), "a　b\nc d\n e  f \n\tg h\t\n　i j　\n")
    d = DS.read_dictionary(spark, p).orderBy("ord").collect()
    want = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")]
    assert [(r["src_word"], r["trg_word"]) for r in d] == want
    blank = _write(os.path.join(scratch, "blank.txt"), "a b\n\nc d\n")
    with pytest.raises(Exception, match="line 2"):
        DS.read_dictionary(spark, blank).collect()
    tabs = _write(os.path.join(scratch, "tabs.txt"), "\ta.b\nc.d\t\n")
    pairs, _ = DS.read_dictionary_tolerant(spark, tabs, delim=".")      # a literal, not a pattern
    assert {(r["src_word"], r["trg_word"]) for r in pairs.collect()} == {("a", "b"), ("c", "d")}
    bad = _write(os.path.join(scratch, "bad.txt"), "a b\nc\nd e f\n")
    with pytest.raises(Exception):
        DS.read_dictionary(spark, bad).collect()
    pairs, rejected = DS.read_dictionary_tolerant(spark, bad)
    assert pairs.count() == 1 and sorted(r["line_no"] for r in rejected.collect()) == [2, 3]


def test_dictionary_manifest_is_one_scan(spark, scratch):
    p1 = _write(os.path.join(scratch, "one.txt"), "a b\nc d\n")
    p2 = _write(os.path.join(scratch, "two.txt"), "e f\n")
    man = _write(os.path.join(scratch, "man.txt"), f"0, 1, {p1}\n1,2,{p2}\n2, 0, {p1}\n")
    got = DS.read_dictionaries(spark, DS.read_dictionary_manifest(spark, man)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, "a", "b"), (0, 1, 1, "c", "d"), (1, 2, 0, "e", "f"),
                                       (2, 0, 0, "a", "b"), (2, 0, 1, "c", "d")]


def test_model_text_layouts(spark, scratch):
    from lexalign.operators.fit import Model
    from lexalign.sources import sinks
    u = {"en": np.array([[1.0, 0.5], [0.25, 2.0], [3.0, 1.0]]), "es": np.eye(2)}
    b = np.array([[2.0, 0.5], [0.5, 1.0]])
    plain = os.path.join(scratch, "plain")
    os.makedirs(plain)
    for name, m in (("U_en", u["en"]), ("U_es", u["es"]), ("B", b)):
        np.savetxt(os.path.join(plain, f"{name}.csv"), m)
    own = os.path.join(scratch, "own")
    sinks.write_model(spark, Model(u, b), own, text=True)
    os.rename(os.path.join(own, "model.parquet"), os.path.join(scratch, "aside"))
    for path in (plain, own):
        back = sinks.read_model(spark, path)
        assert set(back.U) == {"en", "es"} and np.allclose(back.U["en"], u["en"]) and np.allclose(back.B, b)
    os.remove(os.path.join(plain, "B.csv"))
    with pytest.raises(ValueError, match="no model"):
        sinks.read_model(spark, plain)


def test_empty_and_all_oov_dictionary(spark):
    emb = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "idx bigint, word string, vec array<double>")
    empty = spark.createDataFrame([], "ord bigint, src_word string, trg_word string")
    assert D.coverage(empty, emb, emb).first()["coverage"] is None
    oovd = spark.createDataFrame([(0, "x", "y")], "ord bigint, src_word string, trg_word string")
    c = D.coverage(oovd, emb, emb).first()
    assert c["n_covered"] == 0 and c["coverage"] == 0.0


def test_prefix_extension_brute_force(spark):
    words = ["cat", "cats", "catalog", "dog", "do", "house"]
    vecs = {w: [float(i), float(len(w))] for i, w in enumerate(words)}
    emb = spark.createDataFrame([(i, w, vecs[w]) for i, w in enumerate(words)], "idx bigint, word string, vec array<double>")
    req = spark.createDataFrame([("catal",), ("dogs",), ("zebra",), ("cat",), ("hou",)], "word string")
    got = {r["word"]: list(r["vec"]) for r in oov.prefix_embeddings(req, emb).collect()}
    # brute force: longest proper prefix in vocab, shortest extension (lowest id on ties)
    exp = {}
    for w in ["catal", "dogs", "zebra", "hou"]:
        shorter = [v for v in words if w.startswith(v) and v != w]
        longer = [v for v in words if v.startswith(w) and v != w]
        m = []
        if longer:
            m.append(min(longer, key=lambda v: (len(v), words.index(v))))
        if shorter:
            m.append(max(shorter, key=len))
        if m:
            exp[w] = list(np.mean([vecs[v] for v in m], axis=0))
    assert got == exp


def test_streaming_alignment_equals_batch(spark, scratch):
    from lexalign.operators.fit import Model
    from lexalign.operators import mapping as M
    from lexalign.operators import normalize as N
    from lexalign.streaming.project import align_stream, start
    rng = np.random.default_rng(0)
    rows = [(i, f"w{i}", [float(x) for x in rng.normal(size=4)]) for i in range(20)]
    src = os.path.join(scratch, "in")
    spark.createDataFrame(rows, "idx bigint, word string, vec array<double>").write.parquet(src)
    model = Model({"a": np.linalg.qr(rng.normal(size=(4, 4)))[0]}, np.diag([1.0, 2.0, 3.0, 4.0]))
    stream = spark.readStream.schema("idx bigint, word string, vec array<double>").parquet(src)
    q = start(align_stream(stream, model, "a"), os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    got = {r["idx"]: np.array(r["vec"]) for r in spark.read.parquet(os.path.join(scratch, "out")).collect()}
    batch = N.unit(M.to_latent(N.unit(spark.read.parquet(src)), model, "a"))
    for r in batch.collect():
        assert np.allclose(got[r["idx"]], r["vec"])


def test_model_roundtrip_and_metrics_sink(spark, scratch):
    from lexalign.operators.fit import Model
    from lexalign.sources import sinks
    rng = np.random.default_rng(3)
    m = Model({"en": rng.normal(size=(4, 3)), "es": rng.normal(size=(5, 3))}, np.diag([1.0, 2.0, 3.0]))
    sinks.write_model(spark, m, os.path.join(scratch, "model"), text=True)
    back = sinks.read_model(spark, os.path.join(scratch, "model"))
    assert np.allclose(back.U["en"], m.U["en"]) and np.allclose(back.U["es"], m.U["es"])
    assert np.allclose(back.B, m.B)
    met = spark.createDataFrame([(0.5, 0.9)], "acc1 double, coverage double")
    sinks.write_metrics(met, os.path.join(scratch, "metrics"), "a")
    sinks.write_metrics(met, os.path.join(scratch, "metrics"), "b")
    assert spark.read.parquet(os.path.join(scratch, "metrics")).count() == 2


def test_external_vectors_pipe_and_prepend(spark, scratch):
    import sys
    script = _write(os.path.join(scratch, "vec.py"),
                    "import sys\nfor w in sys.stdin:\n    w = w.strip()\n    print(w, len(w), 1.5)\n")
    emb = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "idx bigint, word string, vec array<double>")
    d = spark.createDataFrame([(0, "xyz", "q"), (1, "a", "q")], "ord bigint, src_word string, trg_word string")
    out = oov.extend_with_external([d], emb, f"{sys.executable} {script}").orderBy("idx").collect()
    assert [(r["idx"], r["word"]) for r in out] == [(0, "xyz"), (1, "a"), (2, "b")]
    assert list(out[0]["vec"]) == [3.0, 1.5]


def test_line_order_holds_over_splits(spark, scratch):
    p = _write(os.path.join(scratch, "long.txt"), "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(5000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = vectext.read_lines(spark, p)
        assert spark.read.text(p).rdd.getNumPartitions() > 10
        got = {r["line"]: r["value"] for r in lines.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 5000 and all(got[i].split()[1] == str(i) for i in got)


def test_numbering_shuffles_no_text(spark, scratch):
    paths = [_write(os.path.join(scratch, f"f{i}.txt"), "".join(f"{i} {j} {'y' * (j % 91)}\n" for j in range(700 * (i + 1)))) for i in range(4)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")        # splits of several files share a task
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = vectext.read_files(spark, paths)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        got = lines.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "Window" not in plan
    assert sorted((r["path"], r["line"]) for r in got) == [(p, j) for i, p in enumerate(paths) for j in range(700 * (i + 1))]
    assert all(r["value"].split()[:2] == [str(paths.index(r["path"])), str(r["line"])] for r in got)


def test_capped_load_moves_vectors_once(spark, scratch):
    n = 400
    p = _write(os.path.join(scratch, "big.vec"), f"{n} 2\n" + "".join(f"{'Ww'[i % 2]}{i // 3} {i} 0\n" for i in range(n)))
    rows = vectext.scan(spark, p)
    low, want = {}, []
    for i in range(n):
        w = f"w{i // 3}"
        if w not in low:
            low[w] = i
            want.append((len(want), w, float(i)))
    for cap in (1, 50, 10_000):
        got = sorted((r["idx"], r["word"], r["vec"][0]) for r in vectext.load(rows, max_voc=cap).collect())
        assert got == want[:cap]
    kept = spark.createDataFrame([("W0",), ("w1",), ("w1",), ("nope",)], "word string")
    got = sorted((r["idx"], r["word"]) for r in vectext.load(rows, vocabulary=kept).collect())
    assert [w for _, w in got] == [x for x in (f"{'Ww'[i % 2]}{i // 3}" for i in range(n)) if x in ("W0", "w1")]
    plain = vectext.load(rows, threshold=7, dense=True)
    assert "Exchange hashpartitioning" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 7


def test_gzip_vec_is_read(spark, scratch):
    import gzip
    p = os.path.join(scratch, "g.vec.gz")
    with gzip.open(p, "wt", encoding="utf-8") as f:
        f.write("3 2\nx 1 2\ny 3 4\nz 5 6\n")
    got = vectext.read(spark, p).orderBy("idx").collect()
    assert [r["word"] for r in got] == ["x", "y", "z"] and list(got[2]["vec"]) == [5.0, 6.0]


def test_manifest_to_metrics_model_and_aligned_vectors(spark, scratch):
    from lexalign.operators import normalize as N
    from lexalign.plans import manifest, registry
    from lexalign.sources import sinks
    from tests.conftest import SF0001
    langs = registry._manifests(spark, SF0001, scratch)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = manifest.run(spark, f"{scratch}/emb.list", f"{scratch}/train.list", f"{scratch}/test.list", "s,t,m", model_path=f"{scratch}/model",
                       metrics_path=f"{scratch}/metrics", aligned_path=f"{scratch}/aligned").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert {(r.src_lang, r.trg_lang) for r in out} == {("s", "t"), ("s", "m"), ("m", "t")} and min(r.acc1 for r in out) >= 0.65
    assert spark.read.parquet(f"{scratch}/metrics").count() == 3
    aligned = {(r.lang, r.idx): np.array(r.vec) for r in spark.read.parquet(f"{scratch}/aligned").collect()}
    assert len(aligned) == 3 * 500
    for r in manifest.apply(spark, f"{scratch}/model", f"{scratch}/s.vec", "s").collect():
        assert np.allclose(aligned["s", r.idx], r.vec, atol=1e-9)
    model = sinks.read_model(spark, f"{scratch}/model")
    x = N.normalize(langs["s"], ("unit", "center"))
    for r in manifest.apply(spark, model, langs["s"], "s", "m", normalize_eval=False).join(x.withColumnRenamed("vec", "raw"), "idx").collect():
        assert np.allclose(np.array(r.raw) @ model.cross_map("s", "m"), r.vec)
    with pytest.raises(ValueError, match="no language 'q'"):
        manifest.apply(spark, model, langs["s"], "q")
    short = _write(os.path.join(scratch, "short.list"), f"0, 9, {scratch}/s-t.train\n")
    with pytest.raises(ValueError, match="does not list"):
        manifest.read_pairs(spark, short, {0: "s"})
