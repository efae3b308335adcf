"""DuckDB statements that recompute every registered query from the raw tables.

The fixture rules (FIXTURES.md §3) are restated in SQL, independently of the
Spark code, over the views ``embeddings`` and ``documents``.  Column names and
rounding (6 decimals) match ``lexalign.plans.registry``.
"""

from __future__ import annotations

# Shared fixture CTEs.  `d` is the vector length; 1-based positions in SQL.
FIX = """
nn AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v, label FROM embeddings),
lang_s AS (SELECT i AS idx, 's' || i AS word, v AS vec FROM e),
lang_t AS (SELECT a.i AS idx, 't' || a.i AS word,
                  list_transform(list_zip(list_reverse(a.v), b.v), lambda p: p[1] + 1.5 * p[2]) AS vec
           FROM e a CROSS JOIN nn JOIN e b ON b.i = (a.i + 7) % nn.n),
lang_m AS (SELECT a.i AS idx, 'm' || a.i AS word,
                  list_transform(list_zip(list_concat(a.v[len(a.v) // 2 + 1:], a.v[:len(a.v) // 2]), b.v),
                                 lambda p: p[1] + 0.2 * p[2]) AS vec
           FROM e a CROSS JOIN nn JOIN e b ON b.i = (a.i + 11) % nn.n),
base AS (SELECT vec_id AS i,
                CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS part
         FROM embeddings),
dict_st AS (
    SELECT i * 10 AS ord, 's' || i AS src_word, 't' || i AS trg_word, part FROM base
    UNION ALL SELECT i * 10 + 1, 's' || i, 't' || ((i + 1) % nn.n), part FROM base CROSS JOIN nn
              WHERE i % 7 = 0 AND part <> 'train'
    UNION ALL SELECT i * 10 + 2, 's' || i, 'zz' || i, part FROM base WHERE i % 11 = 0
    UNION ALL SELECT i * 10 + 3, 'yy' || i, 't' || i, part FROM base WHERE i % 13 = 0
    UNION ALL SELECT i * 10 + 4, 's' || i, 't' || i, part FROM base WHERE i % 17 = 0 AND part = 'train'),
widx_s AS (SELECT word, max(idx) AS idx FROM lang_s GROUP BY word),
widx_t AS (SELECT word, max(idx) AS idx FROM lang_t GROUP BY word),
enc AS (SELECT d.ord, d.src_word, d.trg_word, d.part, a.idx AS src_idx, b.idx AS trg_idx
        FROM dict_st d JOIN widx_s a ON a.word = d.src_word JOIN widx_t b ON b.word = d.trg_word),
enc_train AS (SELECT * FROM enc WHERE part = 'train'),
enc_test AS (SELECT * FROM enc WHERE part = 'test'),
gold AS (SELECT DISTINCT src_idx, trg_idx FROM enc_test),
q AS (SELECT DISTINCT src_idx AS idx FROM enc_test)
"""


def _unit(table: str) -> str:
    return (f"(SELECT idx, word, list_transform(vec, lambda x: x / nrm) AS vec FROM "
            f"(SELECT idx, word, vec, CASE WHEN sqrt(list_inner_product(vec, vec)) = 0 THEN 1.0 "
            f"ELSE sqrt(list_inner_product(vec, vec)) END AS nrm FROM {table}))")


def _long(table: str) -> str:
    return (f"(SELECT idx, unnest(generate_series(1, len(vec))) AS j, unnest(vec) AS x FROM {table})")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([FIX.strip()] + [c.strip() for c in ctes if c.strip()]) + "\n"


def _long_out(src: str) -> str:
    return f"SELECT idx::BIGINT AS idx, (j - 1)::BIGINT AS j, round(x, 6) AS value FROM {src}"


# --------------------------------------------------------------------------- retrieval blocks

def _csls_ctes(xs: str, zs: str, prefix: str = "") -> str:
    """sims / r_x / r_z for the spaces ``xs`` (queries drawn from ``q``) and ``zs``."""
    p = prefix
    return f"""
{p}sims AS (SELECT x.idx AS src_idx, z.idx AS trg_idx, list_inner_product(x.vec, z.vec) AS s
          FROM {xs} x CROSS JOIN {zs} z),
{p}rz AS (SELECT trg_idx AS idx, avg(s) AS r FROM
          (SELECT trg_idx, s, row_number() OVER (PARTITION BY trg_idx ORDER BY s DESC, src_idx) AS rn FROM {p}sims)
        WHERE rn <= 10 GROUP BY trg_idx),
{p}rx AS (SELECT src_idx AS idx, avg(s) AS r FROM
          (SELECT src_idx, s, row_number() OVER (PARTITION BY src_idx ORDER BY s DESC, trg_idx) AS rn FROM {p}sims)
        WHERE rn <= 10 GROUP BY src_idx)
"""


def _csls_top(p: str, queries: str, k: int) -> str:
    return f"""
(SELECT src_idx, trg_idx, sc, rn FROM
  (SELECT s.src_idx, s.trg_idx, 2 * s.s - rz.r - rx.r AS sc,
          row_number() OVER (PARTITION BY s.src_idx ORDER BY 2 * s.s - rz.r DESC, s.trg_idx) AS rn
   FROM {p}sims s JOIN {p}rz rz ON rz.idx = s.trg_idx JOIN {p}rx rx ON rx.idx = s.src_idx
   WHERE s.src_idx IN (SELECT idx FROM {queries}))
 WHERE rn <= {k})"""


def _nn_top(p: str, queries: str, k: int) -> str:
    return f"""
(SELECT src_idx, trg_idx, s AS sc, rn FROM
  (SELECT src_idx, trg_idx, s, row_number() OVER (PARTITION BY src_idx ORDER BY s DESC, trg_idx) AS rn
   FROM {p}sims WHERE src_idx IN (SELECT idx FROM {queries}))
 WHERE rn <= {k})"""


COV_CTES = """
pw AS (SELECT d.src_word,
              max(CASE WHEN a.idx IS NOT NULL AND b.idx IS NOT NULL THEN 1 ELSE 0 END) AS ok
       FROM dict_st d LEFT JOIN widx_s a ON a.word = d.src_word LEFT JOIN widx_t b ON b.word = d.trg_word
       WHERE d.part = 'test' GROUP BY d.src_word),
cov AS (SELECT count(*) FILTER (WHERE ok = 1) AS n_covered, count(*) FILTER (WHERE ok = 0) AS n_oov FROM pw)"""


def _acc_ctes(cands: str) -> str:
    """precision@1/5/10 of ``cands(src_idx, trg_idx, rn)`` over the test queries ``q``."""
    return f"""
best AS (SELECT q.idx, min(c.rn) FILTER (WHERE g.src_idx IS NOT NULL) AS best
         FROM q LEFT JOIN {cands} c ON c.src_idx = q.idx
         LEFT JOIN gold g ON g.src_idx = c.src_idx AND g.trg_idx = c.trg_idx
         GROUP BY q.idx),
acc AS (SELECT count(*) AS n_queries,
               avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END) AS acc1,
               avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END) AS acc5,
               avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0.0 END) AS acc10 FROM best)"""


METRICS_SELECT = """
SELECT n_covered::BIGINT AS n_covered, n_oov::BIGINT AS n_oov,
       round(n_covered / (n_covered + n_oov), 6) AS coverage, n_queries::BIGINT AS n_queries,
       round(acc1, 6)::DOUBLE AS acc1, round(acc5, 6)::DOUBLE AS acc5, round(acc10, 6)::DOUBLE AS acc10
FROM cov CROSS JOIN acc
"""


def _metrics_query(*ctes: str, cands: str) -> str:
    return _with(*ctes, COV_CTES, _acc_ctes(cands)) + METRICS_SELECT


# Fixed model: (x·U_s)_j = x_{d+1-j}, (x·U_m)_j = x_{((j-1+d/2) mod d)+1}, B_jj = 1 + (j mod 4).
def _mapped(table: str, perm: str, power: str) -> str:
    """``unit``-less mapped table: ``vec[perm(j)] * b_j^power``."""
    idx = {"rev": "len(vec) + 1 - j", "id": "j", "rot": "((j - 1 + len(vec) // 2) % len(vec)) + 1"}[perm]
    factor = {"half": "sqrt(1 + (j % 4))", "one": "(1 + (j % 4))", "two": "(1 + (j % 4)) * (1 + (j % 4))"}[power]
    return (f"(SELECT idx, word, list_transform(generate_series(1, len(vec)), lambda j: vec[{idx}] * {factor}) AS vec "
            f"FROM {table})")


SQL: dict[str, str] = {}

SQL["norm_unit"] = _with(f"u AS {_unit('lang_t')}") + _long_out(_long("u"))

SQL["norm_center"] = _with(f"l AS {_long('lang_t')}",
                           "c AS (SELECT idx, j, x - avg(x) OVER (PARTITION BY j) AS x FROM l)") + _long_out("c")

SQL["norm_unitdim"] = _with(
    f"l AS {_long('lang_t')}",
    "c AS (SELECT idx, j, x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY j)) = 0 THEN 1.0 "
    "ELSE sqrt(sum(x * x) OVER (PARTITION BY j)) END AS x FROM l)") + _long_out("c")

SQL["norm_centeremb"] = _with(f"l AS {_long('lang_t')}",
                              "c AS (SELECT idx, j, x - avg(x) OVER (PARTITION BY idx) AS x FROM l)") + _long_out("c")

SQL["norm_groups"] = _with(
    f"u AS {_long(_unit('lang_t'))}",
    "c AS (SELECT idx, j, x - avg(x) OVER (PARTITION BY j, idx % 5) AS x FROM u)",
    "ud AS (SELECT idx, j, x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY j, idx % 5)) = 0 THEN 1.0 "
    "ELSE sqrt(sum(x * x) OVER (PARTITION BY j, idx % 5)) END AS x FROM c)") + _long_out("ud")

SQL["norm_chain"] = _with(
    f"u AS {_long(_unit('lang_t'))}",
    "c AS (SELECT idx, j, x - avg(x) OVER (PARTITION BY j) AS x FROM u)",
    "ud AS (SELECT idx, j, x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY j)) = 0 THEN 1.0 "
    "ELSE sqrt(sum(x * x) OVER (PARTITION BY j)) END AS x FROM c)",
    "ce AS (SELECT idx, j, x - avg(x) OVER (PARTITION BY idx) AS x FROM ud)") + _long_out("ce")

SQL["cosine_pairs"] = _with() + """
SELECT s.idx::BIGINT AS idx, round(list_inner_product(s.vec, t.vec), 6) AS dot,
       round(list_inner_product(s.vec, t.vec) / sqrt(list_inner_product(s.vec, s.vec) * list_inner_product(t.vec, t.vec)), 6) AS cosine
FROM lang_s s JOIN lang_t t USING (idx)
"""

SQL["dict_encode"] = _with() + """
SELECT ord::BIGINT AS ord, src_word, trg_word, part, src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx FROM enc
"""

SQL["dict_oov_count"] = _with() + """
SELECT count(*)::BIGINT AS n_pairs,
       count(*) FILTER (WHERE a.idx IS NULL OR b.idx IS NULL)::BIGINT AS n_oov_pairs,
       count(*) FILTER (WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL)::BIGINT AS n_in_vocab
FROM dict_st d LEFT JOIN widx_s a ON a.word = d.src_word LEFT JOIN widx_t b ON b.word = d.trg_word
"""

SQL["dict_distinct"] = _with() + """
SELECT 'src' AS side, src_idx::BIGINT AS idx FROM (SELECT DISTINCT src_idx FROM enc_train)
UNION ALL
SELECT 'trg' AS side, trg_idx::BIGINT AS idx FROM (SELECT DISTINCT trg_idx FROM enc_train)
"""

SQL["dict_weighted"] = _with() + """
SELECT src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx, count(*)::BIGINT AS weight
FROM enc_train GROUP BY src_idx, trg_idx
"""

SQL["dict_reverse"] = _with() + """
SELECT ord::BIGINT AS ord, trg_word AS src_word, src_word AS trg_word, part FROM dict_st
"""

SQL["dict_split"] = _with() + """
SELECT ord::BIGINT AS ord, src_word, trg_word,
       CASE WHEN row_number() OVER (ORDER BY md5('42' || ':' || src_word || ':' || trg_word || ':' || ord::VARCHAR), ord)
                 <= floor(count(*) OVER () * 8 / 10) THEN 'train80' ELSE 'train20' END AS split
FROM dict_st WHERE part = 'train'
"""

SQL["dict_union"] = _with() + """
SELECT src_word, trg_word, count(*)::BIGINT AS n FROM (
    SELECT src_word, trg_word FROM dict_st WHERE part = 'train'
    UNION ALL SELECT src_word, trg_word FROM dict_st WHERE part = 'val'
    UNION ALL SELECT src_word, trg_word FROM dict_st WHERE part = 'train')
GROUP BY src_word, trg_word
"""

SQL["dict_stats"] = _with() + """
SELECT count(*)::BIGINT AS n_pairs, count(DISTINCT src_idx)::BIGINT AS n_src, count(DISTINCT trg_idx)::BIGINT AS n_trg,
       (SELECT count(*) FROM (SELECT DISTINCT src_idx, trg_idx FROM enc_train))::BIGINT AS n_edges
FROM enc_train
"""

SQL["dict_exclude"] = _with() + """
SELECT ord::BIGINT AS ord, src_word, trg_word, part FROM dict_st
WHERE src_word NOT IN (SELECT src_word FROM dict_st WHERE part = 'test')
"""

SQL["gold_multimap"] = _with() + """
SELECT src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx FROM gold
"""

SQL["oov_words"] = _with("""
tl AS (SELECT d.src_word, a.idx AS si, b.idx AS ti FROM dict_st d
       LEFT JOIN widx_s a ON a.word = d.src_word LEFT JOIN widx_t b ON b.word = d.trg_word
       WHERE d.part = 'test')""") + """
SELECT src_word AS word FROM tl WHERE si IS NULL OR ti IS NULL
EXCEPT
SELECT src_word AS word FROM tl WHERE si IS NOT NULL AND ti IS NOT NULL
"""

SQL["vocab_gap"] = _with() + """
SELECT 'src' AS side, word FROM (SELECT src_word AS word FROM dict_st WHERE part IN ('train', 'test')
                                 EXCEPT SELECT word FROM lang_s)
UNION ALL
SELECT 'trg' AS side, word FROM (SELECT trg_word AS word FROM dict_st WHERE part IN ('train', 'test')
                                 EXCEPT SELECT word FROM lang_t)
"""

SQL["vocab_cutoff"] = _with() + """
SELECT d.ord::BIGINT AS ord, a.idx::BIGINT AS src_idx, b.idx::BIGINT AS trg_idx
FROM dict_st d
JOIN (SELECT word, max(idx) AS idx FROM lang_s WHERE idx < (SELECT n // 2 FROM nn) GROUP BY word) a ON a.word = d.src_word
JOIN (SELECT word, max(idx) AS idx FROM lang_t WHERE idx < (SELECT n // 2 FROM nn) GROUP BY word) b ON b.word = d.trg_word
"""

SQL["request_partition"] = _with() + """
SELECT w.word, a.idx IS NOT NULL AS in_vocab, a.idx::BIGINT AS idx
FROM (SELECT DISTINCT src_word AS word FROM dict_st WHERE part = 'test') w LEFT JOIN widx_s a ON a.word = w.word
"""

SQL["emb_filter"] = _with() + "SELECT idx::BIGINT AS idx, word FROM lang_s WHERE vec[1] > 0\n"

SQL["coverage"] = _with(COV_CTES) + """
SELECT n_covered::BIGINT AS n_covered, n_oov::BIGINT AS n_oov, round(n_covered / (n_covered + n_oov), 6) AS coverage FROM cov
"""

_GRAM_X = """
xs AS (SELECT idx, vec FROM lang_s WHERE idx IN (SELECT src_idx FROM enc_train)),
xl AS (SELECT idx, unnest(generate_series(1, len(vec))) AS i, unnest(vec) AS x FROM xs)"""

SQL["gram_xx"] = _with(_GRAM_X) + """
SELECT (a.i - 1)::BIGINT AS i, (b.i - 1)::BIGINT AS j, round(sum(a.x * b.x), 6) AS value
FROM xl a JOIN xl b USING (idx) GROUP BY a.i, b.i
"""

_GRAM_XZ = f"""
sl AS {_long('lang_s')},
tl AS {_long('lang_t')},
ed AS (SELECT src_idx, trg_idx, count(*) AS w FROM enc_train GROUP BY src_idx, trg_idx)"""

SQL["gram_xz"] = _with(_GRAM_XZ) + """
SELECT (a.j - 1)::BIGINT AS i, (b.j - 1)::BIGINT AS j, round(sum(a.x * b.x), 6) AS value
FROM ed JOIN sl a ON a.idx = ed.src_idx JOIN tl b ON b.idx = ed.trg_idx GROUP BY a.j, b.j
"""

SQL["gram_xz_weighted"] = _with(_GRAM_XZ) + """
SELECT (a.j - 1)::BIGINT AS i, (b.j - 1)::BIGINT AS j, round(sum(ed.w * a.x * b.x), 6) AS value
FROM ed JOIN sl a ON a.idx = ed.src_idx JOIN tl b ON b.idx = ed.trg_idx GROUP BY a.j, b.j
"""

_UNIT_ST = f"ux AS {_unit('lang_s')},\nuz AS {_unit('lang_t')}"

SQL["nn_top1"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + f"""
SELECT src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx, round(sc, 6) AS score FROM {_nn_top('', 'q', 1)}
"""

SQL["nn_top10"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + f"""
SELECT src_idx::BIGINT AS src_idx, rn::BIGINT AS rank, trg_idx::BIGINT AS trg_idx, round(sc, 6) AS score
FROM {_nn_top('', 'q', 10)}
"""

SQL["nbr_x"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + """
SELECT idx::BIGINT AS idx, round(r, 6) AS r FROM rx WHERE idx IN (SELECT idx FROM q)
"""

SQL["nbr_z"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + """
SELECT idx::BIGINT AS idx, round(r, 6) AS r FROM rz
"""

SQL["csls_top1"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + f"""
SELECT src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx, round(sc, 6) AS score FROM {_csls_top('', 'q', 1)}
"""

SQL["csls_top10"] = _with(_UNIT_ST, _csls_ctes("ux", "uz")) + f"""
SELECT src_idx::BIGINT AS src_idx, rn::BIGINT AS rank, trg_idx::BIGINT AS trg_idx, round(sc, 6) AS score
FROM {_csls_top('', 'q', 10)}
"""

_REQ = """
req AS (SELECT w.word, a.idx FROM (SELECT DISTINCT src_word AS word FROM dict_st WHERE part = 'test') w
        JOIN widx_s a ON a.word = w.word),
rq AS (SELECT DISTINCT idx FROM req)"""

SQL["translate_nn"] = _with(_UNIT_ST, _csls_ctes("ux", "uz"), _REQ) + f"""
SELECT req.word, t.word AS translation FROM req JOIN {_nn_top('', 'rq', 1)} c ON c.src_idx = req.idx
JOIN lang_t t ON t.idx = c.trg_idx
"""

SQL["translate_csls"] = _with(_UNIT_ST, _csls_ctes("ux", "uz"), _REQ) + f"""
SELECT req.word, t.word AS translation FROM req JOIN {_csls_top('', 'rq', 1)} c ON c.src_idx = req.idx
JOIN lang_t t ON t.idx = c.trg_idx
"""

# DuckDB does not allow a window inside a window: the softmax is in two steps.
SQL["translate_topn_softmax"] = _with(_UNIT_ST, _csls_ctes("ux", "uz"), _REQ, f"""
top AS {_csls_top('', 'rq', 5)},
ex AS (SELECT src_idx, trg_idx, rn, exp(sc - max(sc) OVER (PARTITION BY src_idx)) AS e FROM top)""") + """
SELECT req.word, ex.rn::BIGINT AS rank, t.word AS translation,
       round(ex.e / sum(ex.e) OVER (PARTITION BY ex.src_idx), 6) AS prob
FROM req JOIN ex ON ex.src_idx = req.idx JOIN lang_t t ON t.idx = ex.trg_idx
"""

SQL["induce_bidir"] = _with(_UNIT_ST, """
xs AS (SELECT idx, vec FROM ux),
zs AS (SELECT idx, vec FROM uz)""", _csls_ctes("xs", "zs")) + """
SELECT 'fwd' AS direction, src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx FROM (
    SELECT s.src_idx, s.trg_idx, row_number() OVER (PARTITION BY s.src_idx
           ORDER BY 2 * s.s - rx.r - rz.r DESC, s.trg_idx) AS rn
    FROM sims s JOIN rx ON rx.idx = s.src_idx JOIN rz ON rz.idx = s.trg_idx) WHERE rn = 1
UNION ALL
SELECT 'bwd' AS direction, src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx FROM (
    SELECT s.src_idx, s.trg_idx, row_number() OVER (PARTITION BY s.trg_idx
           ORDER BY 2 * s.s - rx.r - rz.r DESC, s.src_idx) AS rn
    FROM sims s JOIN rx ON rx.idx = s.src_idx JOIN rz ON rz.idx = s.trg_idx) WHERE rn = 1
"""

_FIXED = f"""
xw AS {_unit(_mapped('lang_s', 'rev', 'half'))},
zw AS {_unit(_mapped('lang_t', 'id', 'half'))}"""

SQL["precision_at_k"] = _with(_FIXED, _csls_ctes("xw", "zw"), _acc_ctes(_csls_top('', 'q', 10))) + """
SELECT n_queries::BIGINT AS n_queries, round(acc1, 6)::DOUBLE AS acc1, round(acc5, 6)::DOUBLE AS acc5,
       round(acc10, 6)::DOUBLE AS acc10 FROM acc
"""

SQL["evaluate_nn"] = _metrics_query(_FIXED, _csls_ctes("xw", "zw"), cands=_nn_top('', 'q', 10))

SQL["evaluate_csls"] = _metrics_query(_FIXED, _csls_ctes("xw", "zw"), cands=_csls_top('', 'q', 10))

SQL["word_similarity"] = _with("""
sim AS (SELECT e1.i AS row_no, 's' || e1.i AS w1,
               CASE WHEN e1.i % 19 = 0 THEN 'zz' || e1.i ELSE 's' || e2.i END AS w2,
               abs(e1.label - e2.label)::DOUBLE AS ref
        FROM e e1 CROSS JOIN nn JOIN e e2 ON e2.i = (3 * e1.i + 1) % nn.n),
pairs AS (SELECT sim.row_no, list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)) AS cos, sim.ref
          FROM sim JOIN lang_s a ON a.word = sim.w1 JOIN lang_s b ON b.word = sim.w2),
ranked AS (SELECT rank() OVER (ORDER BY cos) + (count(*) OVER (PARTITION BY cos) - 1) / 2.0 AS r_cos,
                  rank() OVER (ORDER BY ref) + (count(*) OVER (PARTITION BY ref) - 1) / 2.0 AS r_ref FROM pairs)""") + """
, stat AS (SELECT count(*) AS n, corr(r_cos, r_ref) AS rho, count(*) - 2 AS df FROM ranked),
tail AS (  -- two-sided tail of Student's t, its density integrated by Simpson's rule
  SELECT abs(rho) * sqrt(df / (1 - rho * rho)) AS t, df, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS c FROM stat),
simpson AS (
  SELECT sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
             * c * pow(1 + pow(t * k / 2000.0, 2) / df, -(df + 1) / 2.0)) * any_value(t) / 6000 AS inside
  FROM tail, generate_series(0, 2000) g(k))
SELECT (SELECT count(*) FROM sim)::BIGINT AS n_pairs, n::BIGINT AS n_in_vocab,
       round(n / (SELECT count(*) FROM sim), 6) AS pair_coverage, round(rho, 6) AS spearman, round(1 - 2 * inside, 6) AS p_value
FROM stat, simpson
"""

SQL["map_latent"] = _with(f"m AS {_long(_mapped('lang_s', 'rev', 'half'))}") + _long_out("m")

SQL["map_cross"] = _with(f"m AS {_long(_mapped('lang_s', 'rev', 'one'))}") + _long_out("m")

SQL["cmp_eval"] = _metrics_query(f"""
xw AS {_unit(_mapped('lang_s', 'rev', 'two'))},
zw AS {_unit('lang_t')}""", _csls_ctes("xw", "zw"), cands=_csls_top('', 'q', 10))

SQL["pip_eval"] = _metrics_query(
    f"""
x1 AS {_unit(_mapped('lang_s', 'rev', 'half'))},
y1 AS {_unit(_mapped('lang_m', 'rot', 'half'))},
z2 AS {_unit(_mapped('lang_t', 'id', 'half'))}""",
    _csls_ctes("x1", "y1", "a_"),
    f"mid AS (SELECT src_idx, trg_idx AS mid_idx FROM {_csls_top('a_', 'q', 1)})",
    "q2 AS (SELECT DISTINCT mid_idx AS idx FROM mid)",
    _csls_ctes("y1", "z2", "b_"),
    f"c2 AS (SELECT mid.src_idx, t.trg_idx, t.rn FROM mid JOIN {_csls_top('b_', 'q2', 10)} t ON t.src_idx = mid.mid_idx)",
    cands="c2")


# --------------------------------------------------------------------------- sources / sinks / OOV

_TOK = """
tok AS (SELECT unnest(string_split(text, ' ')) AS token, coalesce(lang, 'und') AS lang FROM documents),
ring AS (  -- each language and the one after it
  SELECT lang, coalesce(lead(lang) OVER (ORDER BY lang), min(lang) OVER ()) AS next
  FROM (SELECT DISTINCT coalesce(lang, 'und') AS lang FROM documents))"""

SQL["vec_roundtrip"] = _with() + """
SELECT idx::BIGINT AS idx, word, (j - 1)::BIGINT AS j, CAST(printf('%.6g', x) AS DOUBLE) AS value
FROM (SELECT idx, word, unnest(generate_series(1, len(vec))) AS j, unnest(vec) AS x FROM lang_s)
"""

_LANG_TOK = _TOK + """,
voc AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS line,
               count(*) OVER (PARTITION BY lang) AS lines
        FROM (SELECT lang, token AS word, count(*) AS cnt FROM tok
              WHERE token <> '' GROUP BY lang, token)),
fold AS (SELECT lang, lower(word) AS word, line, lines,
                row_number() OVER (PARTITION BY lang, lower(word) ORDER BY line) AS k FROM voc)"""


def _vocab_out(source: str) -> str:
    """Rows ``(lang, line, word, pos)`` with their vectors ``e[line mod n]``."""
    return f"""
SELECT g.lang, (g.pos - 1)::BIGINT AS idx, g.word, g.line::BIGINT AS line, round(e.v[1], 6) AS v_first,
       round(list_sum(e.v), 6) AS v_sum
FROM ({source}) g CROSS JOIN nn JOIN e ON e.i = g.line % nn.n
"""


_NUMBERED = "row_number() OVER (PARTITION BY lang ORDER BY line) AS pos"

SQL["vocab_cap_fold"] = _with(_LANG_TOK, f"g AS (SELECT *, {_NUMBERED} FROM fold WHERE k = 1)") + _vocab_out(
    "SELECT * FROM g WHERE pos <= greatest(1, lines // 2)")

SQL["vocab_fold_all"] = _with(_LANG_TOK) + _vocab_out(f"SELECT *, {_NUMBERED} FROM fold WHERE k = 1")

SQL["vocab_legacy_bypass"] = _with(_LANG_TOK) + _vocab_out("SELECT *, line AS pos FROM voc")

SQL["vocab_threshold"] = _with(_LANG_TOK) + _vocab_out("SELECT *, line AS pos FROM voc WHERE line <= greatest(1, lines // 2)")

SQL["vocab_filter"] = _with(_LANG_TOK) + _vocab_out(f"""
    SELECT *, {_NUMBERED} FROM voc v WHERE EXISTS (SELECT 1 FROM tok k WHERE k.token = v.word
        AND k.lang = (SELECT next FROM ring WHERE ring.lang = v.lang))""")

SQL["vocab_only"] = _with() + """
SELECT idx::BIGINT AS idx, word FROM lang_t
"""

_LINES = """
lines AS (SELECT row_number() OVER (ORDER BY ord) AS line_no, ord, src_word, trg_word FROM dict_st)"""

SQL["dict_tolerant"] = _with(_LINES) + """
SELECT 'pair' AS kind, src_word, trg_word, NULL::BIGINT AS line_no
FROM (SELECT DISTINCT src_word, trg_word FROM lines WHERE NOT starts_with(src_word, 'yy'))
UNION ALL
SELECT 'rejected' AS kind, NULL::VARCHAR AS src_word, NULL::VARCHAR AS trg_word, line_no::BIGINT AS line_no
FROM lines WHERE starts_with(src_word, 'yy')
"""

SQL["dict_strict"] = _with(_LINES) + """
SELECT (line_no - 1)::BIGINT AS line_no, src_word, trg_word FROM lines
"""

SQL["sim_scan"] = _with("""
sim AS (SELECT e1.i AS row_no, 's' || e1.i AS w1,
               CASE WHEN e1.i % 19 = 0 THEN 'zz' || e1.i ELSE 's' || e2.i END AS w2,
               abs(e1.label - e2.label)::DOUBLE AS ref
        FROM e e1 CROSS JOIN nn JOIN e e2 ON e2.i = (3 * e1.i + 1) % nn.n)""") + """
SELECT row_no::BIGINT AS row_no, w1, w2, ref FROM sim
"""

SQL["manifest_load"] = _with() + """
SELECT 0::BIGINT AS lang_no, 'en' AS lang, idx::BIGINT AS idx, word FROM lang_s
UNION ALL
SELECT 1::BIGINT AS lang_no, 'es' AS lang, idx::BIGINT AS idx, word FROM lang_t
"""

SQL["paste_columns"] = _with() + """
SELECT vec_id::BIGINT AS line, 's' || vec_id AS word, label::BIGINT AS label FROM embeddings
"""

SQL["candidate_lines"] = _with(_FIXED, _csls_ctes("xw", "zw"), f"""
cands AS {_csls_top('', 'q', 10)},
g AS (SELECT gold.src_idx, string_agg(t.word, ':' ORDER BY t.word) AS gw FROM gold JOIN lang_t t ON t.idx = gold.trg_idx
      GROUP BY gold.src_idx),
c AS (SELECT cands.src_idx, string_agg(t.word, ':' ORDER BY cands.rn) AS cw FROM cands JOIN lang_t t ON t.idx = cands.trg_idx
      GROUP BY cands.src_idx)""") + """
SELECT s.word AS src_word, s.word || ',' || g.gw || ',' || c.cw AS line
FROM c JOIN g ON g.src_idx = c.src_idx JOIN lang_s s ON s.idx = c.src_idx
"""

SQL["pairs_tsv"] = SQL["translate_csls"]

_PREFIX = _TOK + """,
words AS (SELECT lang, token AS word, count(*) AS cnt FROM tok WHERE token <> '' GROUP BY ALL),
vv AS (SELECT lang, word, line - 1 AS idx, e.v AS vec
       FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, encode(word)) AS line FROM words)
       CROSS JOIN nn JOIN e ON e.i = line % nn.n),
req AS (SELECT r.lang, r.word FROM (SELECT ring.lang, word FROM words JOIN ring ON ring.next = words.lang) r
        WHERE NOT EXISTS (SELECT 1 FROM vv WHERE vv.lang = r.lang AND vv.word = r.word)),
rp AS (SELECT lang, word, l, substring(word, 1, l) AS prefix
       FROM (SELECT lang, word, unnest(range(1, length(word))) AS l FROM req)),
short AS (SELECT rp.lang, rp.word, arg_max(w.idx, rp.l) AS s_idx, arg_max(w.word, rp.l) AS s_word
          FROM rp JOIN vv w ON w.lang = rp.lang AND w.word = rp.prefix GROUP BY rp.lang, rp.word),
vp AS (SELECT lang, word AS v_word, idx, substring(word, 1, l) AS prefix
       FROM (SELECT lang, word, idx, unnest(range(1, length(word))) AS l FROM vv)),
longer AS (SELECT r.lang, r.word, arg_min(vp.idx, length(vp.v_word) * 1000000000 + vp.idx) AS l_idx,
                  arg_min(vp.v_word, length(vp.v_word) * 1000000000 + vp.idx) AS l_word
           FROM req r JOIN vp ON vp.lang = r.lang AND vp.prefix = r.word GROUP BY r.lang, r.word),
m AS (SELECT r.lang, r.word, s.s_idx, s.s_word, l.l_idx, l.l_word FROM req r
      LEFT JOIN short s ON s.lang = r.lang AND s.word = r.word LEFT JOIN longer l ON l.lang = r.lang AND l.word = r.word
      WHERE s.s_idx IS NOT NULL OR l.l_idx IS NOT NULL),
res AS (SELECT m.lang, m.word, m.s_word, m.l_word,
               CASE WHEN a.vec IS NOT NULL AND b.vec IS NOT NULL
                    THEN list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] + p[2]) / 2.0)
                    WHEN a.vec IS NOT NULL THEN a.vec ELSE b.vec END AS vec
        FROM m LEFT JOIN vv a ON a.lang = m.lang AND a.idx = m.s_idx LEFT JOIN vv b ON b.lang = m.lang AND b.idx = m.l_idx),
sizes AS (SELECT lang, count(*) AS n_new FROM res GROUP BY lang),
extended AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY encode(word)) - 1 AS idx, word, vec FROM res
  UNION ALL SELECT vv.lang, vv.idx + coalesce(n_new, 0), vv.word, vv.vec FROM vv LEFT JOIN sizes USING (lang))"""

SQL["prefix_oov"] = _with(_PREFIX) + """
SELECT lang, word, s_word AS short_word, l_word AS long_word, round(vec[1], 6) AS v_first, round(list_sum(vec), 6) AS v_sum
FROM res
"""

SQL["oov_prepend"] = _with(_PREFIX) + "SELECT lang, idx::BIGINT AS idx, word FROM extended"


# --------------------------------------------------------------------------- fits

def _zeros(*names: str) -> str:
    """A convex objective has its least value where the gradient is zero, whatever the data."""
    fits = ", ".join(f"('{n}')" for n in names)
    return f"""
SELECT fit, a.i::BIGINT AS i, b.i::BIGINT AS j, 0.0::DOUBLE AS value
FROM (VALUES {fits}) f(fit), (SELECT max(len(embedding)) AS d FROM embeddings) n,
     generate_series(0, d - 1) a(i), generate_series(0, d - 1) b(i)
"""


SQL["fit_residual"] = _zeros("lambda 0.1", "lambda 10")
SQL["fit_residual_semi"] = _zeros("semi")
SQL["fit_residual_two_hop"] = _zeros("first", "second")
SQL["multi_fit_eval"] = """
SELECT 3::BIGINT AS n_pairs, TRUE AS not_above_start, TRUE AS converged, TRUE AS stationary, TRUE AS orthonormal,
       TRUE AS positive_definite
"""


# --------------------------------------------------------------------------- file jobs and rarely used branches

_SIX = "list_transform(vec, lambda x: CAST(printf('%.6g', x) AS DOUBLE))"

SQL["map_db"] = _with(f"r AS (SELECT idx, word, {_SIX} AS vec FROM lang_s)",
                      f"u AS {_unit('r')}", f"m AS {_unit(_mapped('u', 'rev', 'half'))}") + """
SELECT idx::BIGINT AS idx, word, (j - 1)::BIGINT AS j, CAST(printf('%.6g', x) AS DOUBLE) AS value
FROM (SELECT idx, word, unnest(generate_series(1, len(vec))) AS j, unnest(vec) AS x FROM m)
"""

SQL["evaluate_from_files"] = _metrics_query(
    f"rs AS (SELECT idx, word, {_SIX} AS vec FROM lang_s)", f"rt AS (SELECT idx, word, {_SIX} AS vec FROM lang_t)",
    f"ux AS {_unit('rs')}", f"uz AS {_unit('rt')}", _csls_ctes("ux", "uz"), cands=_nn_top('', 'q', 10))

SQL["request_words"] = _with() + """
SELECT src_word AS word, count(*)::BIGINT AS n FROM dict_st WHERE part = 'test' GROUP BY src_word
"""

SQL["metrics_sink"] = _with("""
pw AS (SELECT d.part, d.src_word, max(CASE WHEN a.idx IS NOT NULL AND b.idx IS NOT NULL THEN 1 ELSE 0 END) AS ok
       FROM dict_st d LEFT JOIN widx_s a ON a.word = d.src_word LEFT JOIN widx_t b ON b.word = d.trg_word
       WHERE d.part IN ('val', 'test') GROUP BY d.part, d.src_word)""") + """
SELECT part AS fit_id, count(*) FILTER (WHERE ok = 1)::BIGINT AS n_covered, count(*) FILTER (WHERE ok = 0)::BIGINT AS n_oov,
       round(count(*) FILTER (WHERE ok = 1) / count(*), 6) AS coverage
FROM pw GROUP BY part
"""

SQL["metrics_text"] = f"""
SELECT printf('Coverage:%7s  Accuracy:%7s  Accuracy(Top 5):%7s  Accuracy(Top 10):%7s', printf('%.2f%%', coverage * 100),
              printf('%.2f%%', acc1 * 100), printf('%.2f%%', acc5 * 100), printf('%.2f%%', acc10 * 100)) AS value
FROM ({SQL["evaluate_nn"]})
"""

SQL["gzip_scan"] = _with() + """
SELECT idx::BIGINT AS idx, word, CAST(printf('%.6g', vec[1]) AS DOUBLE) AS v_first FROM lang_t
"""

SQL["dict_fold"] = _with() + """
SELECT ord::BIGINT AS ord, src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx FROM enc
"""

SQL["translate_topn_nn"] = _with(_UNIT_ST, _csls_ctes("ux", "uz"), _REQ, f"""
c AS {_nn_top('', 'rq', 5)},
ex AS (SELECT src_idx, ln(sum(exp(sc))) AS total FROM c GROUP BY src_idx)""") + """
SELECT req.word, c.rn::BIGINT AS rank, t.word AS translation, round(c.sc - ex.total, 6) AS log_prob
FROM req JOIN c ON c.src_idx = req.idx JOIN ex ON ex.src_idx = c.src_idx JOIN lang_t t ON t.idx = c.trg_idx
"""

SQL["oov_extend"] = _with(_PREFIX) + """
SELECT lang, idx::BIGINT AS idx, word, round(vec[1], 6) AS v_first, round(list_sum(vec), 6) AS v_sum FROM extended
"""

SQL["oov_extend_file"] = _with(
    "asked AS (SELECT DISTINCT CASE WHEN part = 'test' THEN src_word || '0x' ELSE src_word END AS word FROM dict_st)",
    "gap AS (SELECT word FROM asked WHERE word NOT IN (SELECT word FROM lang_s))",
    "short AS (SELECT g.word, arg_max(s.idx, length(s.word)) AS i FROM gap g JOIN lang_s s ON starts_with(g.word, s.word) GROUP BY g.word)",
    "longer AS (SELECT g.word, arg_min(s.idx, length(s.word) * 1000000000 + s.idx) AS i FROM gap g "
    "JOIN lang_s s ON starts_with(s.word, g.word) GROUP BY g.word)",
    "six AS (SELECT idx, word, CAST(printf('%.6g', vec[1]) AS DOUBLE) AS v FROM lang_s)",
    "new AS (SELECT g.word, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN (a.v + b.v) / 2 ELSE coalesce(a.v, b.v) END AS v "
    "FROM gap g LEFT JOIN short s ON s.word = g.word LEFT JOIN six a ON a.idx = s.i "
    "LEFT JOIN longer l ON l.word = g.word LEFT JOIN six b ON b.idx = l.i WHERE s.i IS NOT NULL OR l.i IS NOT NULL)") + """
SELECT (row_number() OVER (ORDER BY encode(word)) - 1)::BIGINT AS idx, word, CAST(printf('%.6g', v) AS DOUBLE) AS v_first FROM new
UNION ALL SELECT (idx + (SELECT count(*) FROM new))::BIGINT, word, v FROM six
"""


# --------------------------------------------------------------------------- fits on axes

SQL["grid_residual"] = """
SELECT p.a AS src_lang, p.b AS trg_lang, l.x::DOUBLE AS "lambda", 0.0::DOUBLE AS residual
FROM (VALUES ('s', 't'), ('s', 'm'), ('m', 't')) p(a, b), (VALUES (0.01), (0.1), (1), (10), (100), (1000)) l(x)
"""


def _axes(aligned: bool) -> str:
    """``axis(lang, word, p, m)`` and the pairs of every dictionary's training part, with their multiplicity."""
    rows = [("s", 1, 1, "d"), ("t", 3, 2, "d // 2"), ("m", 5, 3, "d // 4")]
    axis = " UNION ALL ".join(
        f"SELECT '{n}' AS lang, '{n}' || i AS word, "
        f"{'i % (d // 4)' if aligned else f'({step} * i) % ({d})'} AS p, 1 + abs(v[{c}]) AS m FROM e, dim"
        for n, step, c, d in rows)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, '{a}' || substr(src_word, 2) AS sw, '{b}' || substr(trg_word, 2) AS tw "
        "FROM dict_st WHERE part = 'train' AND src_word LIKE 's%' AND trg_word LIKE 't%'"
        for a, b in (("s", "t"), ("s", "m"), ("m", "t")))
    return _with(
        "dim AS (SELECT max(len(v)) AS d FROM e)", f"axis AS ({axis})",
        f"pairs AS (SELECT a, b, sw, tw, count(*) AS k FROM ({pairs}) GROUP BY ALL)",
        "sx AS (SELECT a, b, x.p AS i, sum(x.m * x.m) AS g FROM (SELECT DISTINCT a, b, sw FROM pairs) JOIN axis x ON x.word = sw GROUP BY ALL)",
        "sz AS (SELECT a, b, x.p AS j, sum(x.m * x.m) AS g FROM (SELECT DISTINCT a, b, tw FROM pairs) JOIN axis x ON x.word = tw GROUP BY ALL)",
        "cc AS (SELECT a, b, x.p AS i, z.p AS j, sum(x.m * z.m) AS c, sum(k * x.m * z.m) AS ck "
        "FROM pairs JOIN axis x ON x.word = sw JOIN axis z ON z.word = tw GROUP BY ALL)",
        "n AS (SELECT a, b, sum(k) AS n FROM pairs GROUP BY ALL)",
        "ids AS (SELECT a, b, i, j FROM (SELECT DISTINCT a, b FROM pairs), "
        "(SELECT unnest(range(d)) AS i FROM dim), (SELECT unnest(range(d)) AS j FROM dim))")


SQL["fit_exact"] = _axes(False) + """,
size AS (SELECT lang, CASE lang WHEN 's' THEN d WHEN 't' THEN d // 2 ELSE d // 4 END AS d FROM (VALUES ('s'), ('t'), ('m')) l(lang), dim),
w AS (
  SELECT f.fit, f.a, f.b, ids.i, ids.j,
         coalesce(CASE WHEN f.counted THEN ck ELSE c END, 0)
         / (coalesce(sx.g, 0) * coalesce(sz.g, 0) + f.lam / 2 * CASE WHEN f.counted THEN n.n ELSE 1 END) AS value
  FROM (VALUES ('lambda 0.1', 's', 't', 0.1::DOUBLE, FALSE), ('lambda 10', 's', 't', 10, FALSE), ('semi', 's', 't', 0.01, TRUE),
               ('first', 's', 'm', 10, FALSE), ('second', 'm', 't', 10, FALSE)) f(fit, a, b, lam, counted)
  JOIN ids USING (a, b) JOIN n USING (a, b)
  JOIN size za ON za.lang = f.a AND ids.i < za.d JOIN size zb ON zb.lang = f.b AND ids.j < zb.d
  LEFT JOIN sx ON sx.a = f.a AND sx.b = f.b AND sx.i = ids.i LEFT JOIN sz ON sz.a = f.a AND sz.b = f.b AND sz.j = ids.j
  LEFT JOIN cc ON cc.a = f.a AND cc.b = f.b AND cc.i = ids.i AND cc.j = ids.j)
SELECT fit, i::BIGINT AS i, j::BIGINT AS j, round(value, 6) AS value FROM w
UNION ALL
SELECT 'composed', x.i::BIGINT, y.j::BIGINT, round(sum(x.value * y.value), 6)
FROM w x JOIN w y ON x.fit = 'first' AND y.fit = 'second' AND x.j = y.i GROUP BY x.i, y.j
"""

SQL["multi_fit_exact"] = _axes(True) + """,
b AS (  -- one number an axis: each pair's terms over its number of pairs, and the ridge
  SELECT i, sum(c / n.n) / (sum(sx.g * sz.g / n.n) + 0.5) AS beta
  FROM cc JOIN sx USING (a, b, i) JOIN sz ON sz.a = cc.a AND sz.b = cc.b AND sz.j = cc.i JOIN n ON n.a = cc.a AND n.b = cc.b
  WHERE cc.i = cc.j GROUP BY i)
SELECT ids.a AS src_lang, ids.b AS trg_lang, ids.i::BIGINT AS i, ids.j::BIGINT AS j,
       round(CASE WHEN ids.i = ids.j THEN coalesce(beta, 0) ELSE 0 END, 5)::DOUBLE AS value
FROM ids JOIN dim ON ids.i < d // 4 AND ids.j < d // 4 LEFT JOIN b ON b.i = ids.i
"""


# --------------------------------------------------------------------------- manifests, models and aligned vectors by name

def _manifest_pairs(part: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS src_no, {j} AS trg_no, ord, replace(src_word, 's', '{a}') AS src_word, replace(trg_word, 't', '{b}') AS trg_word "
        f"FROM dict_st WHERE part = '{part}'" for i, a, j, b in ((0, "s", 1, "t"), (0, "s", 2, "m"), (2, "m", 1, "t")))
    return f"listed AS (SELECT *, row_number() OVER (PARTITION BY src_no, trg_no ORDER BY ord) - 1 AS line_no FROM ({rows}))"


SQL["dict_manifest"] = _with(_manifest_pairs("train")) + """
SELECT src_no::BIGINT AS src_no, trg_no::BIGINT AS trg_no, line_no::BIGINT AS line_no, src_word, trg_word FROM listed
"""

SQL["model_apply"] = _with(f"u AS {_unit('lang_s')}", f"a AS {_long(_mapped('u', 'rev', 'half'))}",
                           f"b AS {_long(_mapped('u', 'rev', 'one'))}") + \
    f"SELECT *, 'latent' AS space FROM ({_long_out('a')}) UNION ALL SELECT *, 't' AS space FROM ({_long_out('b')})"

_ALIGNED = {lang: _unit(_mapped(f"lang_{lang}", perm, "half")) for lang, perm in (("s", "rev"), ("t", "id"))}
SQL["aligned_sink"] = _with(*(f"m_{lang} AS {q}" for lang, q in _ALIGNED.items())) + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{lang}' AS lang, idx::BIGINT AS idx, word, (j - 1)::BIGINT AS j, {value} AS value "
    f"FROM (SELECT idx, word, unnest(generate_series(1, len(vec))) AS j, unnest(vec) AS x FROM m_{lang})"
    for kind, value in (("table", "round(x, 6)"), ("vec", "CAST(printf('%.6g', x) AS DOUBLE)")) for lang in _ALIGNED)


# --------------------------------------------------------------------------- self-training rounds

SQL["dict_union_induced"] = _with() + f"""
SELECT src_idx::BIGINT AS src_idx, trg_idx::BIGINT AS trg_idx, count(*) AS n
FROM (SELECT src_idx, trg_idx FROM enc_train UNION ALL SELECT src_idx, trg_idx FROM ({SQL["induce_bidir"]}))
GROUP BY ALL
"""

SQL["gram_delta"] = _with(
    "pairs AS (SELECT src_idx, trg_idx FROM enc_train UNION ALL SELECT src_idx, trg_idx FROM enc_train WHERE ord % 7 = 0 "
    "UNION ALL SELECT src_idx, trg_idx FROM enc WHERE part = 'val' AND src_idx % 2 = 0)",
    f"ls AS {_long('lang_s')}", f"lt AS {_long('lang_t')}",
    "w AS (SELECT src_idx, trg_idx, count(*) AS k FROM pairs GROUP BY ALL)",
    "sx AS (SELECT DISTINCT src_idx AS idx FROM pairs)", "sz AS (SELECT DISTINCT trg_idx AS idx FROM pairs)") + """
SELECT 'sxx' AS name, (a.j - 1)::BIGINT AS i, (b.j - 1)::BIGINT AS j, round(sum(a.x * b.x), 5) AS value
FROM sx JOIN ls a ON a.idx = sx.idx JOIN ls b ON b.idx = sx.idx GROUP BY a.j, b.j
UNION ALL
SELECT 'szz', (a.j - 1)::BIGINT, (b.j - 1)::BIGINT, round(sum(a.x * b.x), 5)
FROM sz JOIN lt a ON a.idx = sz.idx JOIN lt b ON b.idx = sz.idx GROUP BY a.j, b.j
UNION ALL
SELECT 'c', (a.j - 1)::BIGINT, (b.j - 1)::BIGINT, round(sum(w.k * a.x * b.x), 5)
FROM w JOIN ls a ON a.idx = w.src_idx JOIN lt b ON b.idx = w.trg_idx GROUP BY a.j, b.j
"""

SQL["nn_top10_pruned"] = SQL["nn_top10"]
SQL["csls_top10_pruned"] = SQL["csls_top10"]


# --------------------------------------------------------------------------- predicates, duplicate words, ties

SQL["emb_filter_batch"] = _with() + "SELECT idx::BIGINT AS idx, word FROM lang_s WHERE vec[1] > vec[2] AND right(word, 1) <> '7'\n"

SQL["dict_duplicates"] = _with(
    "ds AS (SELECT 's' || (idx % 97) AS word, max(idx) AS idx FROM lang_s GROUP BY 1)",
    "dt AS (SELECT 't' || (idx % 97) AS word, max(idx) AS idx FROM lang_t GROUP BY 1)") + """
SELECT d.ord::BIGINT AS ord, ds.idx::BIGINT AS src_idx, dt.idx::BIGINT AS trg_idx
FROM dict_st d JOIN ds ON ds.word = d.src_word JOIN dt ON dt.word = d.trg_word
"""

SQL["nn_ties"] = _with("axis AS (SELECT i, i % (len(v) // 4) AS p FROM e)") + """
SELECT src_idx::BIGINT AS src_idx, rank::BIGINT AS rank, trg_idx::BIGINT AS trg_idx, score::DOUBLE AS score
FROM (SELECT a.i AS src_idx, b.i AS trg_idx, CASE WHEN a.p = b.p THEN 1.0 ELSE 0.0 END AS score,
             row_number() OVER (PARTITION BY a.i ORDER BY a.p = b.p DESC, b.i) AS rank
      FROM axis a, axis b WHERE a.i % 7 = 0)
WHERE rank <= 9
"""

SQL["nn_whole_vocabulary"] = _with(_UNIT_ST) + """
SELECT x.idx::BIGINT AS src_idx, row_number() OVER (PARTITION BY x.idx ORDER BY list_inner_product(x.vec, z.vec) DESC, z.idx) AS rank,
       z.idx::BIGINT AS trg_idx, round(list_inner_product(x.vec, z.vec), 6) AS score
FROM ux x, uz z WHERE x.idx < 3
"""
