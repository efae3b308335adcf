"""Language and dictionary tables derived from the shared ``embeddings`` table.

The rules are fixed (see FIXTURES.md §3) so that Spark and the SQL oracle build
the same rows: a source language ``s`` (the vectors themselves), a target
language ``t`` (reversed vector plus a scaled neighbour row: a planted linear
map with noise), a pivot language ``m`` (half rotation plus noise) and
dictionaries with train/validation/test parts, extra gold, OOV words and
duplicates.  All work is joins and projections over the table; the only driver
value is the row count ``n``, a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.sources import tables

# Fixed values of the fixtures (FIXTURES.md §3).
T_NOISE = 1.5          # lang_t: reverse(e_i) + 1.5 * e_{(i+7) mod n}
T_SHIFT = 7
M_NOISE = 0.2          # lang_m: half rotation of e_i + 0.2 * e_{(i+11) mod n}
M_SHIFT = 11
EXTRA_GOLD_MOD = 7     # extra gold (s_i, t_{i+1}) outside train
OOV_TRG_MOD = 11       # (s_i, 'zz' || i)
OOV_SRC_MOD = 13       # ('yy' || i, t_i)
DUP_MOD = 17           # duplicate train pair
SIM_SKIP_MOD = 19      # similarity rows with an OOV second word


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.embeddings(spark, sf_dir).select(
        F.col("vec_id").cast("bigint").alias("i"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label"),
    )


def _count(spark: SparkSession, sf_dir: str):
    """Row count ``n`` as a scalar subquery (evaluated once inside the plan, no eager job)."""
    return tables.embeddings(spark, sf_dir).agg(F.count(F.lit(1))).scalar()


def _shifted_pair(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Rows ``(i, v, w)`` with ``w = e_{(i+shift) mod n}`` via an equi join."""
    n = _count(spark, sf_dir)
    e = _emb(spark, sf_dir)
    other = e.select(F.col("i").alias("j"), F.col("v").alias("w"))
    return (e.withColumn("j", F.pmod(F.col("i") + shift, n))
             .join(other, "j").select("i", "v", "w"))


def lang_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_language(tables.embeddings(spark, sf_dir), "s")


def lang_t(spark: SparkSession, sf_dir: str, noise: float = T_NOISE,
           prefix: str = "t") -> DataFrame:
    al = F.lit(float(noise))
    p = _shifted_pair(spark, sf_dir, T_SHIFT)
    return p.select(
        F.col("i").alias("idx"),
        F.concat(F.lit(prefix), F.col("i").cast("string")).alias("word"),
        F.zip_with(F.reverse("v"), "w", lambda x, y: x + al * y).alias("vec"),
    )


def lang_t_easy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_t(spark, sf_dir, noise=1.0)


def lang_m(spark: SparkSession, sf_dir: str, noise: float = M_NOISE) -> DataFrame:
    al = F.lit(float(noise))
    p = _shifted_pair(spark, sf_dir, M_SHIFT)
    h = F.size("v") / 2
    rotated = F.concat(F.slice("v", (h + 1).cast("int"), h.cast("int")),
                       F.slice("v", F.lit(1), h.cast("int")))
    return p.select(
        F.col("i").alias("idx"),
        F.concat(F.lit("m"), F.col("i").cast("string")).alias("word"),
        F.zip_with(rotated, "w", lambda x, y: x + al * y).alias("vec"),
    )


#: Axis languages (FIXTURES.md §3): prefix -> (step, component of the embedding, dimension over its length).
AXES = {"s": (1, 0, 1.0), "t": (3, 1, 0.5), "m": (5, 2, 0.25)}


def axis_lang(spark: SparkSession, sf_dir: str, prefix: str, aligned: bool = False) -> DataFrame:
    """A language whose vectors lie on axes, so that its grams are diagonal and fits have a plain closed form.

    Row ``i`` is ``1 + |v_c|`` on axis ``(step * i) mod d``; ``aligned`` puts all languages on axis ``i mod d`` of
    the same ``d``, the smallest.
    """
    step, component, share = AXES[prefix]
    if aligned:
        step, share = 1, min(x for *_, x in AXES.values())
    e = _emb(spark, sf_dir)
    d = (F.size("v") * share).cast("int")
    at = F.pmod(F.col("i") * step, d)
    size = F.abs(F.col("v")[component]) + 1.0
    return e.select(F.col("i").alias("idx"), F.concat(F.lit(prefix), F.col("i").cast("string")).alias("word"), at.alias("_at"),
                    size.alias("_size"), F.sequence(F.lit(0), d - 1).alias("_axes")) \
        .select("idx", "word", F.transform("_axes", lambda j: F.when(j == F.col("_at"), F.col("_size")).otherwise(F.lit(0.0))).alias("vec"))


def _part(i):
    r = F.pmod(i, F.lit(5))
    return F.when(r < 3, "train").when(r == 3, "val").otherwise("test")


def dictionary(spark: SparkSession, sf_dir: str, src: str = "s",
               trg: str = "t") -> DataFrame:
    """``dict_st`` and friends: ``(ord, src_word, trg_word, part)``.

    ``ord = 10*i + variant`` keeps file order: main pair 0, extra gold 1,
    OOV target 2, OOV source 3, duplicate 4.
    """
    n = _count(spark, sf_dir)
    i = F.col("vec_id").cast("bigint")
    base = tables.embeddings(spark, sf_dir).select(i.alias("i"))
    part = _part(F.col("i"))
    sw = F.concat(F.lit(src), F.col("i").cast("string"))
    tw = F.concat(F.lit(trg), F.col("i").cast("string"))
    variants = F.array(
        F.struct(F.lit(0).alias("v"), sw.alias("s"), tw.alias("t")),
        F.when((F.pmod("i", F.lit(EXTRA_GOLD_MOD)) == 0) & (part != "train"),
               F.struct(F.lit(1).alias("v"), sw.alias("s"),
                        F.concat(F.lit(trg), F.pmod(F.col("i") + 1, n).cast("string")).alias("t"))),
        F.when(F.pmod("i", F.lit(OOV_TRG_MOD)) == 0,
               F.struct(F.lit(2).alias("v"), sw.alias("s"),
                        F.concat(F.lit("zz"), F.col("i").cast("string")).alias("t"))),
        F.when(F.pmod("i", F.lit(OOV_SRC_MOD)) == 0,
               F.struct(F.lit(3).alias("v"),
                        F.concat(F.lit("yy"), F.col("i").cast("string")).alias("s"), tw.alias("t"))),
        F.when((F.pmod("i", F.lit(DUP_MOD)) == 0) & (part == "train"),
               F.struct(F.lit(4).alias("v"), sw.alias("s"), tw.alias("t"))),
    )
    return (base.select("i", part.alias("part"), F.explode(variants).alias("r"))
                .where(F.col("r").isNotNull())
                .select((F.col("i") * 10 + F.col("r.v")).cast("bigint").alias("ord"),
                        F.col("r.s").alias("src_word"), F.col("r.t").alias("trg_word"),
                        "part"))


def dictionary_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-training seed: train ``i mod 10 = 0``, val ``i mod 5 = 3``, test ``i mod 5 = 4``."""
    i = F.col("vec_id").cast("bigint")
    part = (F.when(F.pmod(i, F.lit(10)) == 0, "train")
             .when(F.pmod(i, F.lit(5)) == 3, "val")
             .when(F.pmod(i, F.lit(5)) == 4, "test"))
    return (tables.embeddings(spark, sf_dir)
            .select((i * 10).alias("ord"),
                    F.concat(F.lit("s"), i.cast("string")).alias("src_word"),
                    F.concat(F.lit("t"), i.cast("string")).alias("trg_word"),
                    part.alias("part"))
            .where(F.col("part").isNotNull()))


def similarity_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sim(w1, w2, ref)``: ``w1 = s_i``, ``w2 = s_{(3i+1) mod n}``, ``ref = |label_i - label_j|``."""
    n = _count(spark, sf_dir)
    e = tables.embeddings(spark, sf_dir).select(F.col("vec_id").alias("i"), "label")
    o = e.select(F.col("i").alias("j"), F.col("label").alias("label_j"))
    return (e.withColumn("j", F.pmod(F.col("i") * 3 + 1, n))
             .join(o, "j")
             .select(F.col("i").alias("row_no"),
                     F.concat(F.lit("s"), F.col("i").cast("string")).alias("w1"),
                     F.when(F.pmod("i", F.lit(SIM_SKIP_MOD)) == 0,
                            F.concat(F.lit("zz"), F.col("i").cast("string")))
                      .otherwise(F.concat(F.lit("s"), F.col("j").cast("string"))).alias("w2"),
                     F.abs(F.col("label") - F.col("label_j")).cast("double").alias("ref")))


def languages(spark: SparkSession, sf_dir: str) -> list[str]:
    """The languages of ``documents`` in order; rows without one are in ``und``."""
    found = tables.documents(spark, sf_dir).select(F.coalesce("lang", F.lit("und")).alias("lang")).distinct()
    return sorted(r["lang"] for r in found.collect())          # a row a language


def tokens(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """Tokens of ``documents.text`` split on one space, empty tokens dropped: ``(token)``."""
    docs = tables.documents(spark, sf_dir)
    if lang is not None:
        docs = docs.where(F.coalesce("lang", F.lit("und")) == lang)
    return (docs.select(F.explode(F.split("text", " ")).alias("token"))
                .where(F.col("token") != ""))


def vocab_raw(spark: SparkSession, sf_dir: str, lang: str | None = "en") -> DataFrame:
    """``(line, word, vec)``: distinct tokens numbered by count desc then token (1-based),
    ``vec = e_{line mod n}``.  Mixed case gives folding duplicates; shared prefixes
    serve the prefix extension."""
    from lexalign.functions import ranking
    n = _count(spark, sf_dir)
    counts = tokens(spark, sf_dir, lang).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))
    numbered = ranking.row_number_global(counts, [F.col("cnt").desc(), F.col("word").asc()], "line")
    e = _emb(spark, sf_dir).select(F.col("i").alias("_j"), F.col("v").alias("vec"))
    return (numbered.withColumn("_j", F.pmod(F.col("line"), n))
                    .join(e, "_j").select("line", "word", "vec"))
