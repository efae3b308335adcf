"""Mixing: exponent, budget and the drawn rows."""

import math

import numpy as np

from lexalign.llm import mixing

SCHEMA = "doc_id long, text string, source string, block string, n long"


def test_repetition_limit_decides_the_exponent():
    tokens = np.array([900.0, 80, 20, 0])
    w, a, goal = mixing.solve_weights(tokens, max_epochs=2.0)
    assert w[3] == 0 and math.isclose(w.sum(), 1)
    epochs = w[:3] * goal / tokens[:3]
    assert math.isclose(epochs.min(), 1) and math.isclose(epochs.max(), 2, rel_tol=1e-6)
    assert np.allclose(w[:3], tokens[:3] ** a / (tokens[:3] ** a).sum())


def test_target_entropy_and_budget():
    tokens = np.array([900.0, 80, 20])
    w, a, goal = mixing.solve_weights(tokens, budget=500, max_epochs=None, target_entropy=0.9)
    assert math.isclose(mixing.entropy(w), 0.9, rel_tol=1e-6) and goal == 500 and 0 < a < 1
    w, a, _ = mixing.solve_weights(tokens, budget=500, max_epochs=1.0, target_entropy=1.09)
    assert (w * 500 / tokens).max() <= 1 + 1e-6
    assert mixing.solve_weights(np.zeros(3))[2] == 0


def drawn(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, mixing.mix(df, block_tokens=100, **kw).collect()


def test_every_document_once_and_sources_near_their_budget(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 30)), "hot" if i % 3 else f"s{i % 9}", "x", 0) for i in range(900)]
    rows += [(900, None, None, "x", 0), (901, "a b c", None, "x", 0), (902, "", "empty", "x", 0)]
    df, got = drawn(spark, rows, max_epochs=1.5)
    assert {r.doc_id for r in got if r.copy == 0} == {r[0] for r in rows}
    tokens, used = {}, {}
    for i, t, s, *_ in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    for r in got:
        used[r.source] = used.get(r.source, 0) + len((r.text or "").split())
    order = sorted(tokens, key=str)
    w, _, goal = mixing.solve_weights(np.array([tokens[s] for s in order], dtype=float), max_epochs=1.5)
    for s, share in zip(order, w * goal):
        assert share - 31 <= used.get(s, 0) <= share + 1, (s, share, used[s])
    blocks = {}
    for r in got:
        if r.copy == 1:
            blocks.setdefault(r.source, set()).add(r.block)
    whole = {(r.source, r.block): 0 for r in got}
    for r in got:
        whole[r.source, r.block] += 1 if r.copy == 0 else -1
    for s, b in blocks.items():      # all drawn blocks but one are drawn whole
        assert sum(whole[s, x] != 0 for x in b) <= 1
    again = mixing.mix(df, block_tokens=100, max_epochs=1.5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def plain_mix(rows, places, budget, max_epochs, block_tokens):
    """The draws of every source once more, from the places that the rows are given, without Spark."""
    by_source = {}
    for key, source, tokens in rows:
        by_source.setdefault(source, []).append((key, tokens))
    order = sorted(by_source, key=lambda s: (s is not None, s or ""))
    totals = np.array([sum(n for _, n in by_source[s]) for s in order], dtype=float)
    w, _, goal = mixing.solve_weights(totals, budget, max_epochs)
    out = {}
    for s, n, share in zip(order, totals, w * goal):
        share = int(round(share))
        epochs = int(share // n) if n else 1
        rest = share - epochs * n if n else 0
        for key, _ in by_source[s]:
            out[key] = epochs
        blocks = {}
        for key, tokens in by_source[s]:
            blocks.setdefault(places[key, epochs][:2], []).append((places[key, epochs][2], key, tokens))
        for _, inside in sorted(blocks.items()) if rest > 0 else []:
            size = sum(n for *_, n in inside)
            if size <= rest:
                for _, key, _ in inside:
                    out[key] += 1
                rest -= size
                continue
            for _, key, tokens in sorted(inside):
                if tokens > rest:
                    break
                out[key] += 1
                rest -= tokens
            break
    return out


def test_draws_match_a_plain_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"text {i}", ["hot", "hot", "hot", "a", "b", None][i % 6], "x", int(rng.integers(0, 40))) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    for budget, epochs in ((None, 1.5), (9000, 1.0), (40_000, 4.0)):
        got = mixing.mix(df, budget=budget, max_epochs=epochs, block_tokens=300, token_col="n").collect()
        # the places of one more epoch than is drawn come from a mix that draws everything often
        every = mixing.mix(df, budget=400_000, max_epochs=None, block_tokens=300, token_col="n").collect()
        places = {(r.doc_id, r.copy): (r.block_at, r.block, r.doc_at) for r in every}
        assert all(places[r.doc_id, r.copy] == (r.block_at, r.block, r.doc_at) for r in got)
        drawn_ = {}
        for r in got:
            drawn_[r.doc_id] = drawn_.get(r.doc_id, 0) + 1
        want = plain_mix([(r[0], r[2], r[4]) for r in rows], places, budget, epochs, 300)
        assert drawn_ == {k: v for k, v in want.items() if v}


def test_epochs_are_other_permutations_of_whole_blocks(spark):
    rows = [(i, "w " * 10, "a", "x", 0) for i in range(300)]
    _, got = drawn(spark, rows, budget=9000, max_epochs=None)
    orders = []
    for copy in range(3):
        mine = sorted((r for r in got if r.copy == copy), key=lambda r: (r.block_at, r.doc_at))
        blocks = [r.block for r in mine]
        assert len(mine) == 300 and sum(a != b for a, b in zip(blocks, blocks[1:])) == len(set(blocks)) - 1      # a block stays together
        orders.append([r.doc_id for r in mine])
    assert orders[0] != orders[1] != orders[2]


def test_rows_without_an_id_are_dealt_like_others(spark):
    rows = [(None, f"w {i} " * 10, "a", "x", 0) for i in range(400)] + [(5, f"v {i} " * 10, "b", "x", 0) for i in range(200)]
    _, got = drawn(spark, rows, budget=6000, max_epochs=1.0)
    n = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    share = mixing.solve_weights(np.array([8000.0, 4000.0]), 6000, 1.0)[0] * 6000
    assert all(abs(n[s] - x) <= 20 for s, x in zip("ab", share))


def test_tokens_of_a_tokenizer(spark):
    from tokenizers import Tokenizer

    from lexalign.llm.tokens import default_path
    path = default_path("byte_bpe_50k.json")
    texts = ["some words here", "Straße 中文", "", None]
    keyed = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "_key long, _source string, _text string")
    got = {r._key: r._tokens for r in mixing.with_tokens(keyed, path).collect()}
    assert got == {i: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_budget_below_the_corpus_and_token_column(spark):
    rows = [(i, "w", "a" if i < 300 else "b", "x", 10) for i in range(400)] + [(7, "w", "a", "x", None)]
    _, got = drawn(spark, rows, budget=2000, max_epochs=1.0, token_col="n")
    n = {s: sum(10 for r in got if r.source == s and r.n) for s in ("a", "b")}
    assert abs(n["a"] + n["b"] - 2000) <= 20 and n["b"] <= 1000 and max(r.copy for r in got) == 0


def test_empty_table(spark):
    assert drawn(spark, [])[1] == []
    assert mixing.realise_mix(spark, spark.createDataFrame([(1, "a", "s", "b", 1)], SCHEMA), "").columns == [
        "doc_id", "text", "source", "block", "n"]
