"""Named queries over the shared tables (one per operator of the survey).

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are
aliased exactly like the SQL oracle in ``lexalign.plans.oracle_sql``.  Scores
are rounded to 6 decimals, integers are ``bigint``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.functions import ranking
from lexalign.functions import vector as V
from lexalign.operators import dictionary as D
from lexalign.operators import gram as G
from lexalign.operators import mapping as M
from lexalign.operators import metrics as S
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.plans import bilingual as BL
from lexalign.plans.fixed_model import fixed_model
from lexalign.session import materialise
from lexalign.sources import fixtures as FX

DIGITS = 6
SPLIT_SEED = 42
TOPN = 5
CUTOFF_SHARE = 0.5       # of the vocabulary, in the queries about cut-offs


def _r(c, digits: int = DIGITS):
    return F.round(c, digits)


def _long(df: DataFrame, id_col: str = "idx", vec: str = "vec") -> DataFrame:
    """Vectors in long form ``(idx, j, value)`` (0-based ``j``)."""
    return df.select(F.col(id_col).cast("bigint").alias("idx"), F.posexplode(vec).alias("j", "value")) \
             .select("idx", F.col("j").cast("bigint").alias("j"), _r(F.col("value")).alias("value"))


def _st(spark, sf):
    return FX.lang_s(spark, sf), FX.lang_t(spark, sf), FX.dictionary(spark, sf)


def _part(d: DataFrame, part: str) -> DataFrame:
    return d.where(F.col("part") == part)


# --------------------------------------------------------------------------- vectors

def norm_unit(spark, sf):
    return _long(N.normalize(FX.lang_t(spark, sf), ["unit"]))


def norm_center(spark, sf):
    return _long(N.normalize(FX.lang_t(spark, sf), ["center"]))


def norm_unitdim(spark, sf):
    return _long(N.normalize(FX.lang_t(spark, sf), ["unitdim"]))


def norm_centeremb(spark, sf):
    return _long(N.normalize(FX.lang_t(spark, sf), ["centeremb"]))


def norm_groups(spark, sf):
    """Centred and scaled by group, as several languages in one table are."""
    t = FX.lang_t(spark, sf).withColumn("lang", F.pmod("idx", F.lit(5)))
    return _long(N.normalize(t, ["unit", "center", "unitdim"], group_cols=["lang"]))


def norm_chain(spark, sf):
    return _long(N.normalize(FX.lang_t(spark, sf), ["unit", "center", "unitdim", "centeremb"]))


def cosine_pairs(spark, sf):
    """Dot product and cosine of the source and target rows with the same id."""
    s = FX.lang_s(spark, sf).select("idx", F.col("vec").alias("v1"))
    t = FX.lang_t(spark, sf).select("idx", F.col("vec").alias("v2"))
    return s.join(t, "idx").select(F.col("idx").cast("bigint"), _r(V.dot("v1", "v2")).alias("dot"),
                                   _r(V.cosine("v1", "v2")).alias("cosine"))


# --------------------------------------------------------------------------- dictionaries

def dict_encode(spark, sf):
    s, t, d = _st(spark, sf)
    e = D.encode(d, s, t)
    return e.select(F.col("ord").cast("bigint"), "src_word", "trg_word", "part",
                    F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


def dict_oov_count(spark, sf):
    s, t, d = _st(spark, sf)
    return D.oov_pair_count(d, s, t).select(*[F.col(c).cast("bigint") for c in
                                              ("n_pairs", "n_oov_pairs", "n_in_vocab")])


def dict_distinct(spark, sf):
    s, t, d = _st(spark, sf)
    enc = D.encode(_part(d, "train"), s, t)
    src_ids, trg_ids = D.distinct_rows(enc)
    return (src_ids.select(F.lit("src").alias("side"), F.col("src_idx").cast("bigint").alias("idx"))
            .unionByName(trg_ids.select(F.lit("trg").alias("side"), F.col("trg_idx").cast("bigint").alias("idx"))))


def dict_weighted(spark, sf):
    s, t, d = _st(spark, sf)
    w = D.weighted_edges(D.encode(_part(d, "train"), s, t))
    return w.select(F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"),
                    F.col("weight").cast("bigint"))


def dict_reverse(spark, sf):
    d = FX.dictionary(spark, sf)
    return D.reverse(d).select(F.col("ord").cast("bigint"), "src_word", "trg_word", "part")


def dict_split(spark, sf):
    """Seeded 80/20 split of the training part (exact sizes, md5 order)."""
    d = _part(FX.dictionary(spark, sf), "train")
    key = F.md5(F.concat_ws(":", F.lit(str(SPLIT_SEED)), "src_word", "trg_word", F.col("ord").cast("string")))
    keyed = d.withColumn("_h", key)
    numbered = ranking.row_number_global(keyed, [F.col("_h").asc(), F.col("ord").asc()], "pos")
    n = d.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    out = numbered.withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k")
    return out.select(F.col("ord").cast("bigint"), "src_word", "trg_word",
                      F.when(F.col("pos") <= F.floor(F.col("_n") * 0.8), "train80").otherwise("train20").alias("split"))


def dict_union(spark, sf):
    """Induced-style union with duplicates kept: train ∪ val ∪ train-reversed-back."""
    d = FX.dictionary(spark, sf)
    parts = (_part(d, "train").select("src_word", "trg_word", F.lit("a").alias("origin"))
             .unionByName(_part(d, "val").select("src_word", "trg_word", F.lit("b").alias("origin")))
             .unionByName(D.reverse(D.reverse(_part(d, "train"))).select("src_word", "trg_word", F.lit("c").alias("origin"))))
    return parts.groupBy("src_word", "trg_word").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def dict_stats(spark, sf):
    s, t, d = _st(spark, sf)
    st = D.stats(D.encode(_part(d, "train"), s, t))
    return st.select(*[F.col(c).cast("bigint") for c in ("n_pairs", "n_src", "n_trg", "n_edges")])


def dict_exclude(spark, sf):
    d = FX.dictionary(spark, sf)
    out = D.exclude_sources(d, _part(d, "test"))
    return out.select(F.col("ord").cast("bigint"), "src_word", "trg_word", "part")


def gold_multimap(spark, sf):
    s, t, d = _st(spark, sf)
    g = D.gold(D.encode(_part(d, "test"), s, t))
    return g.select(F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


def oov_words(spark, sf):
    s, t, d = _st(spark, sf)
    return D.oov_words(_part(d, "test"), s, t)


def vocab_gap(spark, sf):
    s, t, d = _st(spark, sf)
    tr, te = _part(d, "train"), _part(d, "test")
    return (D.vocab_gap([tr, te], s, "src").select(F.lit("src").alias("side"), "word")
            .unionByName(D.vocab_gap([tr, te], t, "trg").select(F.lit("trg").alias("side"), "word")))


def vocab_cutoff(spark, sf):
    """Frequency cut-off: the dictionary restricted to the first ``CUTOFF_SHARE`` of the ids."""
    s, t, d = _st(spark, sf)
    n = s.count()
    xs = s.where(F.col("idx") < int(n * CUTOFF_SHARE))
    zs = t.where(F.col("idx") < int(n * CUTOFF_SHARE))
    e = D.encode(d, xs, zs)
    return e.select(F.col("ord").cast("bigint"), F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


def request_partition(spark, sf):
    s, t, d = _st(spark, sf)
    words = _part(d, "test").select(F.col("src_word").alias("word")).distinct()
    idx = D.word_index(s)
    out = words.join(idx, "word", "left")
    return out.select("word", F.col("idx").isNotNull().alias("in_vocab"), F.col("idx").cast("bigint"))


def emb_filter(spark, sf):
    s = FX.lang_s(spark, sf)
    return D.filter_embeddings(s, lambda word, vec: vec[0] > 0).select(F.col("idx").cast("bigint"), "word")


def emb_filter_batch(spark, sf):
    """The same with a Python predicate over batches of words and vectors."""
    def keep(words, vectors):
        return [w[-1] != "7" for w in words] & (vectors[:, 0] > vectors[:, 1])
    s = FX.lang_s(spark, sf)
    return D.filter_embeddings_batch(s, keep).select(F.col("idx").cast("bigint"), "word")


def dict_duplicates(spark, sf):
    """Lookups where words stand several times in both vocabularies: the last one counts."""
    s, t, d = _st(spark, sf)
    n = F.lit(97)
    s, t = (df.withColumn("word", F.concat(F.substring("word", 1, 1), F.pmod("idx", n).cast("string"))) for df in (s, t))
    e = D.encode(d, s, t)
    return e.select(F.col("ord").cast("bigint"), F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


def nn_ties(spark, sf):
    """Neighbours among vectors that are mostly equal: ties go to the lower id."""
    x, z = (N.unit(FX.axis_lang(spark, sf, name, aligned=True)) for name in ("s", "t"))
    return _cands_out(R.nn_topk(x.where(F.col("idx") % 7 == 0), z, 9))


def nn_whole_vocabulary(spark, sf):
    """More neighbours asked for than there are: the whole vocabulary in order."""
    xu, zu, *_ = _unit_st(spark, sf)
    return _cands_out(R.nn_topk(xu.where("idx < 3"), zu, zu.count() + 5))


def coverage(spark, sf):
    s, t, d = _st(spark, sf)
    c = D.coverage(_part(d, "test"), s, t)
    return c.select(F.col("n_covered").cast("bigint"), F.col("n_oov").cast("bigint"), _r(F.col("coverage")).alias("coverage"))


# --------------------------------------------------------------------------- grams

def _train_rows(spark, sf):
    s, t, d = _st(spark, sf)
    enc = D.encode(_part(d, "train"), s, t)
    return s, t, enc


def gram_xx(spark, sf):
    s, t, enc = _train_rows(spark, sf)
    src_ids, _ = D.distinct_rows(enc)
    xs = s.join(src_ids.withColumnRenamed("src_idx", "idx"), "idx", "left_semi")
    return _gram_out(G.gram_rows(xs, "vec"))


def _gram_out(rows):
    return G.gram_long(rows, DIGITS).select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), "value")


def _pairs(s, t, edges, weight=None):
    p = (edges.join(s.select(F.col("idx").alias("src_idx"), F.col("vec").alias("xv")), "src_idx")
              .join(t.select(F.col("idx").alias("trg_idx"), F.col("vec").alias("zv")), "trg_idx"))
    return p


def gram_xz(spark, sf):
    s, t, enc = _train_rows(spark, sf)
    return _gram_out(G.gram_rows(_pairs(s, t, D.edges(enc)), "xv", "zv"))


def gram_xz_weighted(spark, sf):
    s, t, enc = _train_rows(spark, sf)
    return _gram_out(G.gram_rows(_pairs(s, t, D.weighted_edges(enc)), "xv", "zv", "weight"))


def gram_delta(spark, sf):
    """Grams of a weighted dictionary after two changes of its pairs, each joined only where it differs."""
    s, t, d = _st(spark, sf)
    enc = D.encode(d, s, t)
    train, val = enc.where("part = 'train'"), enc.where("part = 'val'")
    grams = G.PairGrams(s, t)
    grams.update(train)
    grams.update(train.where("ord % 3 <> 0").unionByName(val).unionByName(val))
    grams.update(train.unionByName(train.where("ord % 7 = 0")).unionByName(val.where("src_idx % 2 = 0")))
    rows = [(name, i, j, float(v)) for name, m in grams.matrices.items() for (i, j), v in np.ndenumerate(m)]    # d x d numbers each
    df = spark.createDataFrame(rows, "name string, i bigint, j bigint, value double")
    return df.withColumn("value", _r(F.col("value"), 5) + F.lit(0.0))


def dict_union_induced(spark, sf):
    """Training pairs of a self-training round: the seed's and the induced ones of both directions, with multiplicity."""
    from lexalign.operators.induce import induce_dictionary
    from lexalign.plans import semi
    xu, zu, d, s, t = _unit_st(spark, sf)
    seed = D.encode(_part(d, "train"), s, t)
    pairs = semi.union_pairs(seed, induce_dictionary(xu, zu, csls_k=10))
    return pairs.groupBy(F.col("src_idx").cast("bigint").alias("src_idx"), F.col("trg_idx").cast("bigint").alias("trg_idx")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# --------------------------------------------------------------------------- retrieval

def _unit_st(spark, sf):
    """Unit vectors of source and target, written once: searches read them several times."""
    s, t, d = _st(spark, sf)
    return materialise(N.unit(s), "unit"), materialise(N.unit(t), "unit"), d, s, t


def _test_queries(xu, s, t, d):
    gold = D.gold(D.encode(_part(d, "test"), s, t))
    q = xu.join(gold.select(F.col("src_idx").alias("idx")).distinct(), "idx", "left_semi")
    return materialise(q, "queries"), gold                     # searches count and read them


def _cands_out(c, with_rank=True):
    cols = [F.col("src_idx").cast("bigint")]
    if with_rank:
        cols.append(F.col("rank").cast("bigint"))
    cols += [F.col("trg_idx").cast("bigint"), _r(F.col("score")).alias("score")]
    return c.select(*cols)


def nn_top1(spark, sf):
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    return _cands_out(R.nn_topk(q, zu, 1), with_rank=False)


def nn_top10(spark, sf):
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    return _cands_out(R.nn_topk(q, zu, 10))


def nbr_x(spark, sf):
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    return R.nbr_mean(q, zu, 10).select(F.col("idx").cast("bigint"), _r(F.col("r")).alias("r"))


def nbr_z(spark, sf):
    xu, zu, d, s, t = _unit_st(spark, sf)
    return R.nbr_mean(zu, xu, 10).select(F.col("idx").cast("bigint"), _r(F.col("r")).alias("r"))


def _csls(spark, sf, k):
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    r_x, r_z = R.neighbourhood(xu, zu, 10, queries=q)
    return R.csls_topk(q, zu, r_z, k, r_x=r_x)


def csls_top1(spark, sf):
    return _cands_out(_csls(spark, sf, 1), with_rank=False)


def csls_top10(spark, sf):
    return _cands_out(_csls(spark, sf, 10))


def nn_top10_pruned(spark, sf):
    """The same rows as ``nn_top10``, by balls with bounds."""
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    return _cands_out(R.pruned_topk(q, zu, 10))


def csls_top10_pruned(spark, sf):
    """The same rows as ``csls_top10`` (scores without the queries' own mean), by balls with bounds."""
    xu, zu, d, s, t = _unit_st(spark, sf)
    q, _ = _test_queries(xu, s, t, d)
    r_x, r_z = R.neighbourhood(xu, zu, 10, queries=q)
    found = R.pruned_topk(q, zu, 10, r_z)
    r_x = r_x.select(F.col("idx").alias("src_idx"), "r")
    return _cands_out(found.join(r_x, "src_idx").withColumn("score", F.col("score") - F.col("r")))


def _translate(spark, sf, method):
    from lexalign.operators.translate import translate
    s, t, d = _st(spark, sf)
    words = _part(d, "test").select(F.col("src_word").alias("word")).distinct()
    return translate(words, s, t, method=method).select("word", "translation")


def translate_nn(spark, sf):
    return _translate(spark, sf, "nn")


def translate_csls(spark, sf):
    return _translate(spark, sf, "csls")


def translate_topn_softmax(spark, sf):
    from lexalign.operators.translate import translate_topn
    s, t, d = _st(spark, sf)
    words = _part(d, "test").select(F.col("src_word").alias("word")).distinct()
    out = translate_topn(words, s, t, method="csls", topn=TOPN)
    return out.select("word", F.col("rank").cast("bigint"), "translation", _r(F.col("prob")).alias("prob"))


def induce_bidir(spark, sf):
    from lexalign.operators.induce import induce_dictionary
    xu, zu, d, s, t = _unit_st(spark, sf)
    ind = induce_dictionary(xu, zu, csls_k=10)
    return ind.select("direction", F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


# --------------------------------------------------------------------------- evaluation

def _fixed_spaces(spark, sf):
    s, t, d = _st(spark, sf)
    dim = BL._dim(s)
    model = fixed_model(dim)
    xw, zw = (materialise(N.unit(M.to_latent(df, model, lang)), "mapped") for df, lang in ((s, "s"), (t, "t")))
    return xw, zw, s, t, d, model


def _metrics_out(df):
    return df.select(F.col("n_covered").cast("bigint"), F.col("n_oov").cast("bigint"),
                     _r(F.col("coverage")).alias("coverage"), F.col("n_queries").cast("bigint"),
                     _r(F.col("acc1")).alias("acc1"), _r(F.col("acc5")).alias("acc5"),
                     _r(F.col("acc10")).alias("acc10"))


def precision_at_k(spark, sf):
    xw, zw, s, t, d, _ = _fixed_spaces(spark, sf)
    gold = D.gold(D.encode(_part(d, "test"), s, t))
    c = BL.retrieve(xw, zw, gold, "csls", 10, 10)
    acc = S.precision_at_k(c, gold)
    return acc.select(F.col("n_queries").cast("bigint"), _r(F.col("acc1")).alias("acc1"),
                      _r(F.col("acc5")).alias("acc5"), _r(F.col("acc10")).alias("acc10"))


def evaluate_nn(spark, sf):
    xw, zw, s, t, d, _ = _fixed_spaces(spark, sf)
    return _metrics_out(BL.evaluate(xw, zw, _part(d, "test"), s, t, method="nn"))


def evaluate_csls(spark, sf):
    xw, zw, s, t, d, _ = _fixed_spaces(spark, sf)
    return _metrics_out(BL.evaluate(xw, zw, _part(d, "test"), s, t, method="csls"))


def word_similarity(spark, sf):
    s = FX.lang_s(spark, sf)
    sim = FX.similarity_set(spark, sf)
    out = S.word_similarity(s, sim)
    return out.select(F.col("n_pairs").cast("bigint"), F.col("n_in_vocab").cast("bigint"),
                      _r(F.col("pair_coverage")).alias("pair_coverage"), _r(F.col("spearman")).alias("spearman"),
                      _r(F.col("p_value")).alias("p_value"))


# --------------------------------------------------------------------------- fixed-model mapping

def map_latent(spark, sf):
    s = FX.lang_s(spark, sf)
    model = fixed_model(BL._dim(s))
    return _long(M.to_latent(s, model, "s"))


def map_cross(spark, sf):
    s = FX.lang_s(spark, sf)
    model = fixed_model(BL._dim(s))
    return _long(M.to_language(s, model, "s", "t"))


def cmp_eval(spark, sf):
    from lexalign.plans import two_hop
    s, t, d = _st(spark, sf)
    model = fixed_model(BL._dim(s))
    out = two_hop.composition_eval(s, t, _part(d, "test"), model.cross_map("s", "m"), model.cross_map("m", "t"))
    return _metrics_out(out)


def pip_eval(spark, sf):
    from lexalign.plans import two_hop
    s, t, d = _st(spark, sf)
    m = FX.lang_m(spark, sf)
    model = fixed_model(BL._dim(s))
    out = two_hop.pipeline_eval(s, m, t, _part(d, "test"), model, model)
    return _metrics_out(out)


# --------------------------------------------------------------------------- sources / sinks

def _scratch(spark, name):
    from lexalign.session import scratch_path
    return scratch_path(spark, name)


def vec_roundtrip(spark, sf):
    """``.vec`` sink (``%.6g``) and scan of the source language."""
    from lexalign.sources import vectext
    path = _scratch(spark, "lang_s.vec")
    vectext.write_vec(FX.lang_s(spark, sf), path)
    back = vectext.read(spark, path)
    return back.select(F.col("idx").cast("bigint").alias("idx"), "word",
                       F.posexplode("vec").alias("j", "value")) \
               .select("idx", "word", F.col("j").cast("bigint").alias("j"), "value")


def _per_lang(spark, sf, load):
    """``load(rows, lang, number of rows)`` of every language's vocabulary, with vectors."""
    out = None
    for lang in FX.languages(spark, sf):
        rows = FX.vocab_raw(spark, sf, lang)
        one = load(rows, lang, rows.count()).select(
            F.lit(lang).alias("lang"), F.col("idx").cast("bigint"), "word", F.col("line").cast("bigint"),
            _r(F.col("vec")[0]).alias("v_first"), _r(V.vsum("vec")).alias("v_sum"))
        out = one if out is None else out.unionByName(one)
    return out


def vocab_cap_fold(spark, sf):
    """Cap at ``CUTOFF_SHARE`` of each language's lines, with folding."""
    from lexalign.sources import vectext
    return _per_lang(spark, sf, lambda rows, _, n: vectext.load(rows, max_voc=max(1, int(n * CUTOFF_SHARE))))


def vocab_fold_all(spark, sf):
    """Folding and de-duplication with a cap beyond the vocabulary."""
    from lexalign.sources import vectext
    return _per_lang(spark, sf, lambda rows, _, n: vectext.load(rows, max_voc=2 * n))


def vocab_legacy_bypass(spark, sf):
    """The same cap with the bypass asked for: nothing is folded."""
    from lexalign.sources import vectext
    return _per_lang(spark, sf, lambda rows, _, n: vectext.load(rows, max_voc=2 * n, count=n, legacy_bypass=True))


def vocab_threshold(spark, sf):
    from lexalign.sources import vectext
    return _per_lang(spark, sf, lambda rows, _, n: vectext.load(rows, threshold=max(1, int(n * CUTOFF_SHARE))))


def vocab_filter(spark, sf):
    """Each language's vocabulary restricted to the tokens of the next language."""
    from lexalign.sources import vectext

    langs = FX.languages(spark, sf)

    def keep(lang):
        other = langs[(langs.index(lang) + 1) % len(langs)]
        return FX.tokens(spark, sf, other).select(F.col("token").alias("word")).distinct()
    return _per_lang(spark, sf, lambda rows, lang, _: vectext.load(rows, vocabulary=keep(lang)))


def vocab_only(spark, sf):
    """Words of a written ``.vec`` file (no folding, no de-duplication)."""
    from lexalign.sources import vectext
    path = _scratch(spark, "lang_t.vec")
    vectext.write_vec(FX.lang_t(spark, sf), path)
    return vectext.read_vocab(spark, path).select(F.col("idx").cast("bigint"), "word")


def _dict_text(spark, sf, malformed=True):
    """Dictionary lines in ``ord`` order; OOV-source rows get a third field when ``malformed``."""
    d = FX.dictionary(spark, sf)
    third = F.when(F.col("src_word").startswith("yy") & F.lit(malformed), F.lit(" extra")).otherwise(F.lit(""))
    return d.select("ord", F.concat(F.col("src_word"), F.lit(" "), F.col("trg_word"), third).alias("text"))


def _write_ordered(df, key, path):
    df.repartitionByRange(key).sortWithinPartitions(key).select("text").write.mode("overwrite").text(path)


def dict_tolerant(spark, sf):
    from lexalign.sources import dictionaries as DS
    path = _scratch(spark, "dict_st.txt")
    _write_ordered(_dict_text(spark, sf), "ord", path)
    pairs, rejected = DS.read_dictionary_tolerant(spark, path)
    return (pairs.select(F.lit("pair").alias("kind"), "src_word", "trg_word", F.lit(None).cast("bigint").alias("line_no"))
            .unionByName(rejected.select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("src_word"),
                                         F.lit(None).cast("string").alias("trg_word"), F.col("line_no").cast("bigint"))))


def dict_strict(spark, sf):
    from lexalign.sources import dictionaries as DS
    path = _scratch(spark, "dict_strict.txt")
    _write_ordered(_dict_text(spark, sf, malformed=False), "ord", path)
    d = DS.read_dictionary(spark, path)
    return d.select(F.col("ord").cast("bigint").alias("line_no"), "src_word", "trg_word")


def sim_scan(spark, sf):
    from lexalign.sources import dictionaries as DS
    path = _scratch(spark, "sim.tsv")
    sim = FX.similarity_set(spark, sf)
    lines = sim.select(F.col("row_no").alias("ord"),
                       F.concat_ws("\t", "w1", "w2", F.col("ref").cast("string")).alias("text"))
    _write_ordered(lines, "ord", path)
    return DS.read_similarity(spark, path).select(F.col("row_no").cast("bigint"), "w1", "w2", "ref")


def manifest_load(spark, sf):
    """Embedding manifest with language names; every listed file is loaded."""
    from lexalign.sources import dictionaries as DS
    from lexalign.sources import vectext
    base = _scratch(spark, "manifest")
    paths = []
    for name, df in (("s", FX.lang_s(spark, sf)), ("t", FX.lang_t(spark, sf))):
        p = f"{base}/{name}.vec"
        vectext.write_vec(df, p)
        paths.append(p)
    man_path = f"{base}/emb.list"
    _write_ordered(spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "ord bigint, text string"),
                   "ord", man_path)
    man = DS.read_embedding_manifest(spark, man_path, lang_list="en,es")
    out = None
    for r in man.collect():      # one row per language
        t = vectext.read(spark, r["path"]).select(
            F.lit(r["lang_no"]).alias("lang_no"), F.lit(r["lang"]).alias("lang"), "idx", "word")
        out = t if out is None else out.unionByName(t)
    return out.select(F.col("lang_no").cast("bigint"), "lang", F.col("idx").cast("bigint"), "word")


def _manifests(spark, sf, base):
    """Vector files of three languages, dictionary files of their pairs, and the manifests that list them."""
    from lexalign.sources import vectext
    names = ("s", "t", "m")
    langs = {"s": FX.lang_s(spark, sf), "t": FX.lang_t(spark, sf), "m": FX.lang_m(spark, sf)}
    for name, df in langs.items():
        vectext.write_vec(df, f"{base}/{name}.vec")
    lists = {"emb": [f"{base}/{name}.vec" for name in names], "train": [], "test": []}
    for a, b in ((0, 1), (0, 2), (2, 1)):
        d = FX.dictionary(spark, sf, names[a], names[b])
        for part in ("train", "test"):
            path = f"{base}/{names[a]}-{names[b]}.{part}"
            _write_ordered(_part(d, part).select("ord", F.concat_ws(" ", "src_word", "trg_word").alias("text")), "ord", path)
            lists[part].append(f"{a}, {b}, {path}")
    for kind, lines in lists.items():
        _write_ordered(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord bigint, text string"), "ord", f"{base}/{kind}.list")
    return langs


def dict_manifest(spark, sf):
    """All dictionaries that a manifest lists, read in one scan."""
    from lexalign.sources import dictionaries as DS
    base = _scratch(spark, "manifest")
    _manifests(spark, sf, base)
    d = DS.read_dictionaries(spark, DS.read_dictionary_manifest(spark, f"{base}/train.list"))
    return d.select(F.col("src_no").cast("bigint"), F.col("trg_no").cast("bigint"), F.col("ord").cast("bigint").alias("line_no"),
                    "src_word", "trg_word")


def manifest_eval(spark, sf):
    """Manifests to metrics: three languages fitted on all training dictionaries, all test dictionaries scored together."""
    from lexalign.plans import manifest
    base = _scratch(spark, "manifest")
    _manifests(spark, sf, base)
    out = manifest.run(spark, f"{base}/emb.list", f"{base}/train.list", f"{base}/test.list", "s,t,m",
                       model_path=f"{base}/model", metrics_path=f"{base}/metrics", aligned_path=f"{base}/aligned")
    return out.select("src_lang", "trg_lang", F.col("n_covered").cast("bigint"), F.col("n_oov").cast("bigint"),
                      _r(F.col("coverage")).alias("coverage"), F.col("n_queries").cast("bigint"),
                      *[_r(F.col(c)).alias(c) for c in ("acc1", "acc5", "acc10")])


def model_apply(spark, sf):
    """A model written as a table and as text, read back and applied by language names: to the shared space and across."""
    from lexalign.plans import manifest
    from lexalign.sources import sinks
    base = _scratch(spark, "model")
    s = FX.lang_s(spark, sf)
    model = fixed_model(BL._dim(s))
    sinks.write_model(spark, model, f"{base}/table", "one")
    sinks.write_model(spark, model, f"{base}/text", "two", text=True, table=False)
    latent = manifest.apply(spark, f"{base}/table", s, "s", normalize=("unit",), normalize_eval=False, fit_id="one")
    across = manifest.apply(spark, f"{base}/text", s, "s", "t", normalize=("unit",), normalize_eval=False)
    return _long(latent).withColumn("space", F.lit("latent")).unionByName(_long(across).withColumn("space", F.lit("t")))


def aligned_sink(spark, sf):
    """Two languages mapped into the shared space, written by language and as vector files, both read back."""
    from lexalign.sources import sinks, vectext
    xw, zw, *_ = _fixed_spaces(spark, sf)
    base = _scratch(spark, "aligned")
    tables = {"s": xw, "t": zw}
    sinks.write_aligned(tables, f"{base}/table")
    sinks.write_aligned(tables, f"{base}/text", "vec")
    out = spark.read.parquet(f"{base}/table").select(F.lit("table").alias("kind"), "lang", "idx", "word", "vec")
    for lang in tables:
        back = vectext.read(spark, f"{base}/text/emb_{lang}.vec")
        out = out.unionByName(back.select(F.lit("vec").alias("kind"), F.lit(lang).alias("lang"), "idx", "word", "vec"))
    return out.select("kind", "lang", F.col("idx").cast("bigint").alias("idx"), "word", F.posexplode("vec").alias("j", "value")) \
              .select("kind", "lang", "idx", "word", F.col("j").cast("bigint").alias("j"),
                      F.when(F.col("kind") == "table", _r(F.col("value"))).otherwise(F.col("value")).alias("value"))


def paste_columns(spark, sf):
    from lexalign.sources import dictionaries as DS
    from lexalign.sources import vectext
    e = FX.lang_s(spark, sf)
    lab = tables_embeddings(spark, sf)
    p1, p2 = _scratch(spark, "words.txt"), _scratch(spark, "labels.txt")
    _write_ordered(e.select(F.col("idx").alias("ord"), F.col("word").alias("text")), "ord", p1)
    _write_ordered(lab.select(F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("text")), "ord", p2)
    pasted = DS.paste(vectext.read_lines(spark, p1), vectext.read_lines(spark, p2))
    return pasted.select(F.col("line").cast("bigint"), F.col("l_value").alias("word"),
                         F.col("r_value").cast("bigint").alias("label"))


def tables_embeddings(spark, sf):
    from lexalign.sources import tables
    return tables.embeddings(spark, sf)


def candidate_lines(spark, sf):
    from lexalign.sources import sinks
    xw, zw, s, t, d, _ = _fixed_spaces(spark, sf)
    gold = D.gold(D.encode(_part(d, "test"), s, t))
    c = BL.retrieve(xw, zw, gold, "csls", 10, 10)
    return sinks.candidate_lines(c, gold, s, t)


def pairs_tsv(spark, sf):
    from lexalign.sources import sinks
    from lexalign.sources import vectext
    pairs = _translate(spark, sf, "csls")
    path = _scratch(spark, "pairs.tsv")
    sinks.translation_lines(pairs).write.mode("overwrite").text(path)
    back = vectext.read_lines(spark, path)
    t = F.split("value", "\t")
    return back.select(t[0].alias("word"), t[1].alias("translation"))


def map_db(spark, sf):
    """Scan, map and write the source vocabulary; the written file is read back."""
    from lexalign.plans import files
    from lexalign.sources import vectext
    src, out = _scratch(spark, "lang_s.vec"), _scratch(spark, "mapped_s.vec")
    s = FX.lang_s(spark, sf)
    vectext.write_vec(s, src)
    files.map_embedding_db(spark, src, fixed_model(BL._dim(s)), "s", out)
    back = vectext.read(spark, out)
    return back.select(F.col("idx").cast("bigint").alias("idx"), "word", F.posexplode("vec").alias("j", "value")) \
               .select("idx", "word", F.col("j").cast("bigint").alias("j"), "value")


def evaluate_from_files(spark, sf):
    """Two written vector files and a written dictionary to metrics, vocabularies capped and folded."""
    from lexalign.plans import files
    from lexalign.sources import vectext
    s, t, d = _st(spark, sf)
    paths = []
    for name, df in (("s", s), ("t", t)):
        paths.append(_scratch(spark, f"{name}.vec"))
        vectext.write_vec(df, paths[-1])
    words = _scratch(spark, "test.txt")
    _write_ordered(_part(d, "test").select("ord", F.concat_ws(" ", F.upper("src_word"), "trg_word").alias("text")), "ord", words)
    return _metrics_out(files.evaluate_files(spark, *paths, words, max_voc=s.count(), method="nn"))


def request_words(spark, sf):
    """Word-list source: stripped lines, blank ones dropped."""
    from lexalign.sources import dictionaries as DS
    path = _scratch(spark, "words.txt")
    d = _part(FX.dictionary(spark, sf), "test").select("ord", "src_word").distinct()
    lines = d.select("ord", F.concat(F.lit("\t "), "src_word", F.lit(" \u3000")).alias("text")) \
        .unionByName(d.select("ord", F.lit(" \t").alias("text")))
    _write_ordered(lines, "ord", path)
    return DS.read_words(spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def metrics_sink(spark, sf):
    """Metrics of two runs appended to one table and read back."""
    from lexalign.sources import sinks
    path = _scratch(spark, "metrics")
    s, t, d = _st(spark, sf)
    for part in ("val", "test"):
        sinks.write_metrics(D.coverage(_part(d, part), s, t), path, part)
    back = spark.read.parquet(path)
    return back.select("fit_id", F.col("n_covered").cast("bigint"), F.col("n_oov").cast("bigint"),
                       _r(F.col("coverage")).alias("coverage"))


def metrics_text(spark, sf):
    """Metrics as a line of percentages."""
    from lexalign.sources import sinks
    return sinks.metrics_lines(evaluate_nn(spark, sf))


def gzip_scan(spark, sf):
    """A compressed vector file."""
    from lexalign.sources import vectext
    path = _scratch(spark, "lang_t.vec")
    t = FX.lang_t(spark, sf)
    vectext.to_lines(t, BL._dim(t), t.count()).repartitionByRange("key").sortWithinPartitions("key").select("text") \
        .write.option("compression", "gzip").text(path)
    back = vectext.read(spark, path)
    return back.select(F.col("idx").cast("bigint"), "word", F.col("vec")[0].alias("v_first"))


def dict_fold(spark, sf):
    """Case folding of dictionary words before they are looked up."""
    s, t, d = _st(spark, sf)
    mixed = d.withColumn("src_word", F.initcap("src_word")).withColumn("trg_word", F.upper("trg_word"))
    return D.encode(mixed, s, t, fold_case=True).select(
        F.col("ord").cast("bigint"), F.col("src_idx").cast("bigint"), F.col("trg_idx").cast("bigint"))


def translate_topn_nn(spark, sf):
    """Top-n translations by inner product with log-probabilities."""
    from lexalign.operators.translate import translate_topn
    s, t, d = _st(spark, sf)
    words = _part(d, "test").select(F.col("src_word").alias("word")).distinct()
    out = translate_topn(words, s, t, method="nn", topn=TOPN)
    return out.select("word", F.col("rank").cast("bigint"), "translation", _r(F.col("prob")).alias("log_prob"))


# --------------------------------------------------------------------------- OOV

def _oov_request(spark, sf):
    """``(space, word)``: the tokens of the next language, asked for in each language."""
    out, langs = None, FX.languages(spark, sf)
    for i in range(len(langs)):
        one = FX.tokens(spark, sf, langs[(i + 1) % len(langs)]).select(F.lit(i).cast("bigint").alias("space"), F.col("token").alias("word"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _vocabularies(spark, sf):
    """``(space, idx, word, vec)`` of all languages."""
    out = None
    for i, lang in enumerate(FX.languages(spark, sf)):
        one = FX.vocab_raw(spark, sf, lang).select(F.lit(i).cast("bigint").alias("space"), (F.col("line") - 1).cast("bigint").alias("idx"),
                                                   "word", "vec")
        out = one if out is None else out.unionByName(one)
    return out


def _named(df, sf):
    langs = F.array(*map(F.lit, FX.languages(df.sparkSession, sf)))
    return df.withColumn("lang", langs[F.col("space").cast("int")]).drop("space")


def prefix_oov(spark, sf):
    """Vectors for unseen words in every language, from the words' longest prefixes and shortest extensions."""
    from lexalign.operators import oov
    out = oov.prefix_embeddings(_oov_request(spark, sf), _vocabularies(spark, sf))
    return _named(out, sf).select("lang", "word", "short_word", "long_word", _r(F.col("vec")[0]).alias("v_first"),
                              _r(V.vsum("vec")).alias("v_sum"))


def oov_prepend(spark, sf):
    """The same words put before every vocabulary."""
    from lexalign.operators import oov
    emb = _vocabularies(spark, sf)
    new = oov.prefix_embeddings(_oov_request(spark, sf), emb).select("space", "word", "vec")
    return _named(oov.prepend(emb, new, keys=["space"]), sf).select("lang", F.col("idx").cast("bigint"), "word")


def oov_extend(spark, sf):
    """Dictionary-driven extension of every language: words a dictionary asks for -> prefix vectors -> prepended."""
    from lexalign.operators import oov
    wanted = _oov_request(spark, sf).select("space", F.col("word").alias("src_word"), F.col("word").alias("trg_word"))
    out = oov.extend_with_prefix([wanted], _vocabularies(spark, sf), "src")
    return _named(out, sf).select("lang", F.col("idx").cast("bigint"), "word", _r(F.col("vec")[0]).alias("v_first"),
                              _r(V.vsum("vec")).alias("v_sum"))


def oov_extend_file(spark, sf):
    """A written vector file extended by the words a dictionary asks for; the file that comes of it is read back."""
    from lexalign.operators import oov
    from lexalign.sources import vectext
    src, out = _scratch(spark, "lang_s.vec"), _scratch(spark, "extended.vec")
    s, d = FX.lang_s(spark, sf), FX.dictionary(spark, sf)
    vectext.write_vec(s, src)
    asked = d.select(F.concat("src_word", F.when(F.col("part") == "test", F.lit("0x")).otherwise(F.lit(""))).alias("src_word"), "trg_word")
    oov.extend_file(spark, src, [asked], out)
    back = vectext.read(spark, out)
    return back.select(F.col("idx").cast("bigint").alias("idx"), "word", F.col("vec")[0].alias("v_first"))


# --------------------------------------------------------------------------- fits

def bilingual_eval(spark, sf):
    s, t, d = _st(spark, sf)
    out = BL.run(s, t, _part(d, "train"), _part(d, "test"), lam=10.0)
    return _metrics_out(out)


def semi_bootstrap(spark, sf):
    from lexalign.plans import semi
    s, t = FX.lang_s(spark, sf), FX.lang_t_easy(spark, sf)
    d = FX.dictionary_seed(spark, sf)
    full = _part(d, "train")
    out = semi.bootstrap(s, t, full, full.where(F.pmod("ord", F.lit(500)) != 0), _part(d, "val"), _part(d, "test"), lam=0.01)
    return out.select("round", "phase", "n_pairs", *[_r(F.col(c)).alias(c) for c in
                                                     ("val_acc1", "test_acc1", "test_acc5", "test_acc10")])


def _residual_out(spark, fits):
    """Long form ``(fit, i, j, value)`` of fit residuals (``d x d`` numbers a fit)."""
    rows = [(name, i, j, float(v)) for name, model in fits for (i, j), v in np.ndenumerate(model.info["residual"])]
    df = spark.createDataFrame(rows, "fit string, i bigint, j bigint, value double")
    return df.withColumn("value", _r(F.col("value")) + F.lit(0.0))      # no minus zero


def fit_residual(spark, sf):
    """Gradient of the convex objective at the fits of Entry 1, in units of the largest entry of C: zero."""
    s, t, d = _st(spark, sf)
    xn, zn = N.normalize(s, ["unit", "center"]), N.normalize(t, ["unit", "center"])
    enc = D.encode(_part(d, "train"), s, t)
    return _residual_out(spark, [(f"lambda {lam:g}", BL.fit_pairs(xn, zn, enc, lam)) for lam in (0.1, 10.0)])


def fit_residual_semi(spark, sf):
    """The same for the self-training objective (pairs with multiplicity)."""
    s, t, d = _st(spark, sf)
    xn, zn = N.normalize(s, ["unit", "center"]), N.normalize(t, ["unit", "center"])
    model = BL.fit_pairs(xn, zn, D.encode(_part(d, "train"), s, t), 0.01, semi=True)
    return _residual_out(spark, [("semi", model)])


def fit_residual_two_hop(spark, sf):
    """The same for both fits of the two-hop job."""
    from lexalign.plans import two_hop
    s, t, m = FX.lang_s(spark, sf), FX.lang_t(spark, sf), FX.lang_m(spark, sf)
    fits = two_hop.fit(s, m, t, _part(FX.dictionary(spark, sf, "s", "m"), "train"),
                       _part(FX.dictionary(spark, sf, "m", "t"), "train"), lam=10.0)
    for f in fits:
        f.release()
    return _residual_out(spark, [(name, f.model) for name, f in zip(("first", "second"), fits)])


def fit_exact(spark, sf):
    """Maps of languages on axes, where the optimum is a quotient: bilingual for two lambdas (by the grid), with
    multiplicities, both hops and their product; source, target and middle have different dimensions."""
    from lexalign.plans import grid
    langs = {name: FX.axis_lang(spark, sf, name) for name in ("s", "t", "m")}
    train = {(a, b): _part(FX.dictionary(spark, sf, a, b), "train") for a, b in (("s", "t"), ("s", "m"), ("m", "t"))}

    def fit(a, b, lam, semi=False):
        return BL.fit_pairs(langs[a], langs[b], D.encode(train[a, b], langs[a], langs[b]), lam, semi=semi).cross_map("src", "trg")
    first, second = fit("s", "m", 10.0), fit("m", "t", 10.0)
    maps = {"semi": fit("s", "t", 0.01, semi=True), "first": first, "second": second, "composed": M.compose(first, second)}
    rows = [(name, i, j, float(v)) for name, m in maps.items() for (i, j), v in np.ndenumerate(m)]     # d x d numbers a fit
    table = None
    for name in ("s", "t"):
        one = langs[name].select(F.lit(name).alias("lang"), "idx", "word", "vec")
        table = one if table is None else table.unionByName(one)
    pairs = spark.createDataFrame([(0, "s", "t")], "space bigint, src_lang string, trg_lang string")
    models = grid.fit_all(grid.pair_grams(table, pairs, train["s", "t"].withColumn("space", F.lit(0).cast("bigint"))), (0.1, 10.0))
    by_grid = models.where("part = 'w'").select(
        F.when(F.col("model") == 0, "lambda 0.1").otherwise("lambda 10").alias("fit"), F.col("i").cast("bigint").alias("i"),
        F.posexplode("row").alias("j", "value")).withColumn("j", F.col("j").cast("bigint"))
    every = spark.createDataFrame(rows, "fit string, i bigint, j bigint, value double").unionByName(by_grid)
    return every.withColumn("value", _r(F.col("value")) + F.lit(0.0))


def multi_fit_exact(spark, sf):
    """The shared ``B`` fit of three languages on the same axes: the maps of all pairs, diagonal at the optimum."""
    from lexalign.plans import multi
    langs = {name: FX.axis_lang(spark, sf, name, aligned=True) for name in ("s", "t", "m")}
    train = [(a, b, _part(FX.dictionary(spark, sf, a, b), "train")) for a, b in (("s", "t"), ("s", "m"), ("m", "t"))]
    model, norm = multi.fit(langs, train, lam=1.0, normalize=("none",), max_iter=5000, gtol=1e-9, tol=0.0)
    for df in norm.values():
        df.unpersist()
    rows = [(a, b, i, j, float(v)) for a, b, _ in train for (i, j), v in np.ndenumerate(model.cross_map(a, b))]
    df = spark.createDataFrame(rows, "src_lang string, trg_lang string, i bigint, j bigint, value double")
    return df.withColumn("value", _r(F.col("value"), 5) + F.lit(0.0))


def _multi_inputs(spark, sf):
    s, t, m = FX.lang_s(spark, sf), FX.lang_t(spark, sf), FX.lang_m(spark, sf)
    langs = {"s": s, "t": t, "m": m}
    dst, dsm, dmt = (FX.dictionary(spark, sf, "s", "t"), FX.dictionary(spark, sf, "s", "m"),
                     FX.dictionary(spark, sf, "m", "t"))
    train = [("s", "t", _part(dst, "train")), ("s", "m", _part(dsm, "train")), ("m", "t", _part(dmt, "train"))]
    tests = [("s", "t", _part(dst, "test")), ("s", "m", _part(dsm, "test")), ("m", "t", _part(dmt, "test"))]
    return langs, train, tests


def multi_fit_eval(spark, sf):
    """The shared-``B`` fit of all pairs: what must hold of any minimum on its manifolds."""
    from lexalign.plans import multi
    langs, train, tests = _multi_inputs(spark, sf)
    model, norm = multi.fit(langs, train, lam=10.0)
    for df in norm.values():
        df.unpersist()
    info = model.info
    return spark.createDataFrame([(
        len(train), info["cost"] <= info["start_cost"], info["converged"],
        info["gradient_norm"] <= 1e-3 * max(1.0, abs(info["cost"])),
        all(bool(np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-8)) for u in model.U.values()),
        bool(np.linalg.eigvalsh(model.B).min() > 0))],
        "n_pairs bigint, not_above_start boolean, converged boolean, stationary boolean, orthonormal boolean, "
        "positive_definite boolean")


def multi_pair_eval(spark, sf):
    from lexalign.plans import multi
    langs, train, tests = _multi_inputs(spark, sf)
    model, norm = multi.fit(langs, train, lam=10.0)
    mapped = multi.mapped_languages(model, norm)
    for df in norm.values():
        df.unpersist()
    return multi.evaluate_pairs(mapped, tests)


def two_hop_fit(spark, sf):
    from lexalign.plans import two_hop
    s, t, m = FX.lang_s(spark, sf), FX.lang_t(spark, sf), FX.lang_m(spark, sf)
    dsm, dmt, dst = (FX.dictionary(spark, sf, "s", "m"), FX.dictionary(spark, sf, "m", "t"),
                     FX.dictionary(spark, sf, "s", "t"))
    f1, f2 = two_hop.fit(s, m, t, _part(dsm, "train"), _part(dmt, "train"), lam=10.0)
    test = _part(dst, "test")
    cmp_ = two_hop.composition_eval(f1.x, f2.z, test, f1.model.cross_map("s", "m"), f2.model.cross_map("m", "t"),
                                    x_raw=s, z_raw=t).select(F.lit("cmp").alias("method"), "*")
    pip = two_hop.pipeline_eval(f1.x, f1.z, f2.z, test, f1.model, f2.model, raw=(s, m, t)) \
        .select(F.lit("pip").alias("method"), "*")
    out = materialise(cmp_.unionByName(pip), "metrics")
    f1.release()
    f2.release()
    return out


def _keyed_inputs(spark, sf):
    """All three languages as one table, their pairs, and the dictionaries of all pairs with their part."""
    langs, words = None, None
    for name, df in (("s", FX.lang_s(spark, sf)), ("t", FX.lang_t(spark, sf)), ("m", FX.lang_m(spark, sf))):
        one = df.select(F.lit(name).alias("lang"), "idx", "word", "vec")
        langs = one if langs is None else langs.unionByName(one)
    names = [("s", "t"), ("s", "m"), ("m", "t")]
    for i, (a, b) in enumerate(names):
        one = FX.dictionary(spark, sf, a, b).select(F.lit(i).cast("bigint").alias("space"), "src_word", "trg_word", "part")
        words = one if words is None else words.unionByName(one)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "space bigint, src_lang string, trg_lang string")
    return langs, pairs, words


def lambda_grid(spark, sf):
    """Six values of lambda for each of three language pairs, in one job."""
    from lexalign.plans import grid
    langs, pairs, words = _keyed_inputs(spark, sf)
    return grid.grid(langs, pairs, _part(words, "train"), _part(words, "test"))


def grid_residual(spark, sf):
    """Largest entry of the gradient of the convex objective at every fit of the grid: zero."""
    from lexalign.plans import grid
    langs, pairs, words = _keyed_inputs(spark, sf)
    norm = N.normalize(langs, ["unit", "center"], group_cols=["lang"])
    models = grid.fit_all(grid.pair_grams(norm, pairs, _part(words, "train")), grid.LAMBDAS)
    infos = grid.model_infos(models, grid.LAMBDAS)
    return infos.join(F.broadcast(pairs), infos["pair"] == pairs["space"]).select(
        "src_lang", "trg_lang", "lambda", (_r(F.col("residual")) + F.lit(0.0)).alias("residual"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "norm_unit": norm_unit,
    "norm_center": norm_center,
    "norm_unitdim": norm_unitdim,
    "norm_centeremb": norm_centeremb,
    "norm_groups": norm_groups,
    "norm_chain": norm_chain,
    "cosine_pairs": cosine_pairs,
    "dict_encode": dict_encode,
    "dict_oov_count": dict_oov_count,
    "dict_distinct": dict_distinct,
    "dict_weighted": dict_weighted,
    "dict_reverse": dict_reverse,
    "dict_split": dict_split,
    "dict_union": dict_union,
    "dict_stats": dict_stats,
    "dict_exclude": dict_exclude,
    "gold_multimap": gold_multimap,
    "oov_words": oov_words,
    "vocab_gap": vocab_gap,
    "vocab_cutoff": vocab_cutoff,
    "request_partition": request_partition,
    "emb_filter": emb_filter,
    "emb_filter_batch": emb_filter_batch,
    "dict_duplicates": dict_duplicates,
    "nn_ties": nn_ties,
    "nn_whole_vocabulary": nn_whole_vocabulary,
    "coverage": coverage,
    "gram_xx": gram_xx,
    "gram_xz": gram_xz,
    "gram_xz_weighted": gram_xz_weighted,
    "gram_delta": gram_delta,
    "dict_union_induced": dict_union_induced,
    "nn_top1": nn_top1,
    "nn_top10": nn_top10,
    "nbr_x": nbr_x,
    "nbr_z": nbr_z,
    "csls_top1": csls_top1,
    "csls_top10": csls_top10,
    "nn_top10_pruned": nn_top10_pruned,
    "csls_top10_pruned": csls_top10_pruned,
    "translate_nn": translate_nn,
    "translate_csls": translate_csls,
    "translate_topn_softmax": translate_topn_softmax,
    "induce_bidir": induce_bidir,
    "precision_at_k": precision_at_k,
    "evaluate_nn": evaluate_nn,
    "evaluate_csls": evaluate_csls,
    "word_similarity": word_similarity,
    "map_latent": map_latent,
    "map_cross": map_cross,
    "cmp_eval": cmp_eval,
    "pip_eval": pip_eval,
    "vec_roundtrip": vec_roundtrip,
    "vocab_cap_fold": vocab_cap_fold,
    "vocab_fold_all": vocab_fold_all,
    "vocab_legacy_bypass": vocab_legacy_bypass,
    "vocab_threshold": vocab_threshold,
    "vocab_filter": vocab_filter,
    "vocab_only": vocab_only,
    "dict_tolerant": dict_tolerant,
    "dict_strict": dict_strict,
    "sim_scan": sim_scan,
    "manifest_load": manifest_load,
    "paste_columns": paste_columns,
    "dict_manifest": dict_manifest,
    "manifest_eval": manifest_eval,
    "model_apply": model_apply,
    "aligned_sink": aligned_sink,
    "candidate_lines": candidate_lines,
    "pairs_tsv": pairs_tsv,
    "prefix_oov": prefix_oov,
    "oov_prepend": oov_prepend,
    "oov_extend": oov_extend,
    "oov_extend_file": oov_extend_file,
    "map_db": map_db,
    "evaluate_from_files": evaluate_from_files,
    "request_words": request_words,
    "metrics_sink": metrics_sink,
    "metrics_text": metrics_text,
    "gzip_scan": gzip_scan,
    "dict_fold": dict_fold,
    "translate_topn_nn": translate_topn_nn,
    "bilingual_eval": bilingual_eval,
    "semi_bootstrap": semi_bootstrap,
    "multi_fit_eval": multi_fit_eval,
    "multi_pair_eval": multi_pair_eval,
    "two_hop_fit": two_hop_fit,
    "lambda_grid": lambda_grid,
    "grid_residual": grid_residual,
    "fit_residual": fit_residual,
    "fit_residual_semi": fit_residual_semi,
    "fit_residual_two_hop": fit_residual_two_hop,
    "fit_exact": fit_exact,
    "multi_fit_exact": multi_fit_exact,
}
