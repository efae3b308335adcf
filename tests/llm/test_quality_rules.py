"""Base rules against a plain reading of their definitions; the model against sums to one; verdicts."""

import re

import numpy as np

from lexalign.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_counts(spark):
    rng = np.random.default_rng(0)
    texts = [None, "", " \n\t", "a b c a b c", "x\x0by\x0cz\xa0w\x1cq #$ <|>\n\nl l\nl l\nl l ", "é" * 5_000, "r " * 3_000]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab", "c", "Ü", " ", " ", "\n", "\t", "#", "d e f"], 120)))
    rows = [(i, t, [None, "en", "de"][i % 3], "x") for i, t in enumerate(texts)] + [(None, "no id", None, "x"), (3, texts[3], None, "x")]
    got = q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(i, *brute(t)) for i, t, _, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                            for r in got))) == sorted(map(str, want))
    assert not any(r.kept for r in got if r.base_failed)


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)).encode() for n in (0, 2, 3, 40, 200, 500)] + [b"\n", b"a b c"]
    want = [brute(t.decode())[4] for t in texts]
    assert q.Words(texts).repeated().tolist() == want and sum(want) > 100
    monkeypatch.setattr(q, "mix64", lambda x: x % np.uint64(7))
    assert q.Words(texts).repeated().tolist() == want


def test_stretches_cover_the_batch(monkeypatch):
    langs, texts = ["en", None, "en", "de", "en", None], [b"a b", b"", b"c" * 50, b"d e", b"f", b"g"]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(q, "STRETCH", size)
        got = {i: (lang, t) for lang, rows, words in q.in_stretches(langs, texts) for i, t in zip(rows, words.texts)}
        assert got == {i: x for i, x in enumerate(zip(langs, texts))}


def test_scripts_keep_their_letters_apart():
    for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "àáâãäåæçèéêëìíîïñòóôõöùúûü"):
        c, _ = q.classes([letters.encode()])
        assert len(set(c.tolist())) == len(letters) + 1 and c.max() < q.CLASSES


def _model(words):
    gram, _ = q.trigrams(words)
    return q.Model(*q.summed(gram, np.ones(len(gram), dtype=np.int64)))


def test_model_is_a_distribution():
    words = "the that then this a an and ant tan nat жук жар".encode().split()
    gram, lengths = q.trigrams(words)
    used, n = np.unique(gram, return_counts=True)
    model = q.Model(used, n)
    for context in np.unique(used >> q.CHAR_BITS):
        at = np.exp(model.log_probability((context << q.CHAR_BITS) + np.arange(q.CLASSES)))
        assert abs(at.sum() - 1) < 1e-5


def test_mixture_is_a_distribution_over_words():
    """All words of up to three letters of a small alphabet have at most the whole probability, and nearly that."""
    models = q.Models({"en": _model([b"ab", b"a", b"ba", b"ab"] * 20)}, _model([b"ab", b"ccc", b"a", b"c"] * 20))
    from itertools import product
    alphabet = [chr(i) for i in range(33, 127)]
    words = ["".join(w) for n in (1, 2) for w in product(alphabet, repeat=n)]
    total = sum(np.exp(models.log_probability("en", q.Words([w.encode()]))[0]) for w in words[:94] + ["ab", "ba", "aa", "bb", "cc"])
    every = np.exp(models.log_probability("en", q.Words([w.encode() for w in words]))).sum()
    assert total < every < 1.0
    own, other = models.log_probability("en", q.Words([b"ab", b"ccc"]))
    lone = models.log_probability("de", q.Words([b"ab", b"ccc"]))
    assert own > other and abs(other - (lone[1] + np.log(q.POOLED))) < 0.05


def test_verdicts_match_a_plain_model(spark):
    """Counts, both fits, bands and verdicts, once more without Spark, Arrow or batches."""
    rng = np.random.default_rng(8)
    syllables = {"en": ["the", "an", "ing", "re"], "de": ["sch", "ver", "ung", "ein"], "ru": ["при", "вет", "мир", "ово"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], int(rng.integers(1, 4)))) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(60, 160))), lang, "x") for i, lang in enumerate(["en", "de", "ru"] * 25)]
    rows += [(100 + i, " ".join(w[::-1] + "#" for w in text("en", 90).split()), "en", "x") for i in range(3)]
    rows += [(200, text("ru", 90), "de", "x"), (201, "short", "en", "x"), rows[0], rows[4]]

    def passes(t):
        return not brute(t)[5]

    def fit(texts):
        grams = {}
        for t, lang in texts:
            for w in t.split():
                for g in q.trigrams([w.encode()])[0].tolist():
                    for key in (lang, "pooled"):
                        grams.setdefault(key, {}).setdefault(g, 0)
                        grams[key][g] += 1
        made = {k: q.Model(np.array(list(v)), np.array(list(v.values()))) for k, v in grams.items()}
        return made

    def perplexity(t, lang, made):
        logp, chars = 0.0, 0
        for w in t.split():
            g = q.trigrams([w.encode()])[0]
            a, b = made[lang].log_probability(g).sum(), made["pooled"].log_probability(g).sum()
            logp += np.logaddexp(np.log(1 - q.POOLED) + a, np.log(q.POOLED) + b)
            chars += len(w) + 1
        return -logp / chars, chars

    def bands(texts, made):
        out = {}
        for lang in {x for _, x in texts}:
            bins = np.array([(np.floor(perplexity(t, x, made)[0] / q.BIN) + 0.5) * q.BIN for t, x in texts if x == lang])
            half = (len(bins) - 1) // 2 if len(bins) % 2 else len(bins) // 2 - 1
            middle = np.sort(bins)[half]
            out[lang] = middle, max(q.LEAST_SCATTER, 1.4826 * np.sort(np.abs(bins - middle))[half])
        return out

    def inside(t, lang, made, of, low, high):
        p, chars = perplexity(t, lang, made)
        width = of[lang][1] + q.CHAR_SCATTER / (chars + 1) ** 0.5
        return of[lang][0] - low * width <= p <= of[lang][0] + high * width

    texts = sorted({(t, lang) for _, t, lang, _ in rows if passes(t)})
    first = fit(texts)
    trimmed = bands(texts, first)
    second = fit([x for x in texts if inside(*x, first, trimmed, q.TRIM_LOWER, q.TRIM_UPPER)])
    final = bands(texts, second)
    want = {i: passes(t) and bool(inside(t, lang, second, final, q.LOWER, q.UPPER)) for i, t, lang, _ in rows}
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.kept for i, r in got.items()} == want and not want[100] and not want[200]
    for i, t, lang, _ in rows:
        if passes(t):
            assert abs(got[i].log_perplexity - perplexity(t, lang, second)[0]) < 1e-4


def test_language_groups_give_the_same_verdicts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    syllables = {"en": ["the", "an", "ing", "re"], "de": ["sch", "ver", "ung", "ein"], None: ["qu", "ou", "que", "la"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(80, 200))), lang, "x") for i, lang in enumerate(["en", "de", None] * 40)]
    junk = [(1000 + i, " ".join(w + "###" for w in text("en", 150).upper().split()), "en", "x") for i in range(4)]
    df = spark.createDataFrame(rows + junk, SCHEMA)
    kept = {r.doc_id: r.kept for r in q.judge(df).collect()}
    assert sum(kept[r[0]] for r in rows) >= 0.97 * len(rows)
    assert not any(kept[r[0]] for r in junk)
    monkeypatch.setattr(q, "MODEL_ENTRIES", 1)
    assert {r.doc_id: r.kept for r in q.judge(df).collect()} == kept
    left = q.keep_good(spark, df, "")
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_copies_decide_no_more_than_one_text(spark):
    rng = np.random.default_rng(5)
    syllables = {"en": ["the", "an", "ing", "re"], "de": ["sch", "ver", "ung", "ein"]}

    def text(lang):
        return " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(int(rng.integers(80, 200))))
    rows = [(i, text(lang), lang, "x") for i, lang in enumerate(["en"] * 120 + ["de"] * 40)]
    rows += [(900 + i, " ".join(w + "###" for w in text("en").upper().split()), "en", "x") for i in range(4)]

    def judged(df):
        return {(r.doc_id, r.kept, r.log_perplexity, r.median, r.scatter) for r in q.judge(df).collect()}
    want = judged(spark.createDataFrame(rows, SCHEMA))
    assert sum(kept for i, kept, *_ in want if i < 900) >= 155 and not any(kept for i, kept, *_ in want if i >= 900)
    for i in (0, 120):                                                 # one text is a third of all rows
        copies = [rows[i]] * 82
        assert judged(spark.createDataFrame(rows + copies, SCHEMA)) == want


def test_distinct_texts(spark, monkeypatch):
    rows = [(lang, t) for lang in ("a", None) for t in ("x", "y", None, "")] + [("a", f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows + rows[:6] * 3, "lang string, text string")
    assert sorted(map(str, map(tuple, q.distinct_texts(df).collect()))) == sorted(map(str, rows))
    monkeypatch.setattr(q, "SLOT_WORDS", 1)                            # all rows share few bits
    assert sorted(map(str, map(tuple, q.distinct_texts(df).collect()))) == sorted(map(str, rows))


def test_scatter_has_a_floor(spark):
    scored = spark.createDataFrame([(False, "en", 1.5, i, i) for i in range(9)],
                                   "base_failed boolean, lang string, log_perplexity double, hash_a long, hash_b long")
    assert q.bands(scored)["en"].scatter == q.LEAST_SCATTER


def test_only_short_texts(spark):
    rows = [(0, "a few words", "en", "x"), (1, "wenige", "de", "x"), (2, "x y", None, "x"), (3, None, "en", "x"), (4, "", "de", "x")]
    got = {r.doc_id: r for r in q.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(range(5)) and not any(r.kept for r in got.values())
    assert all(abs(got[i].log_perplexity - np.log(q.CLASSES)) < 1e-9 for i in range(3)) and got[3].log_perplexity is None


def test_no_accepted_text(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join("".join(rng.choice(["the", "an", "ing"], 3)) for _ in range(90)), lang, "x")
            for i, lang in enumerate(["en"] * 30 + [None])]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(q, "LEAST_SCATTER", 0.0)
    bands = q.bands

    def missed(scored):                                                # the null language's band lies off its text
        out = bands(scored)
        out[None].median += 1.0
        return out
    monkeypatch.setattr(q, "bands", missed)
    got = q.judge(df).collect()
    assert len(got) == 31 and all(np.isfinite(r.log_perplexity) for r in got)


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_character_has_counts_of_its_own():
    """Code points that are equal modulo 160, and the null character, are told apart."""
    letters = [chr(c) for c in (0, 1, 31, 127, 0xE9, 0xE9 + 160, 0xE9 + 320, 0x4E00, 0x4E00 + 160, 0xD7FF, 0x1F600, 0x10FFFF)]
    c, lengths = q.classes(["".join(letters).encode(), b"a"])
    assert len(set(c.tolist())) == len(letters) + 2 and c.max() < q.CLASSES and lengths.tolist() == [len(letters) + 1, 2]
    gram, _ = q.trigrams([x.encode() for x in ("é中", chr(0xE9 + 160) + "中", "é" + chr(0x4E00 + 160))])
    assert len(set(gram.tolist())) == 8                                # é starts two of the words
    model = _model(["éaé".encode()] * 9)
    seen, other = (model.log_probability(q.trigrams([w.encode()])[0])[0] for w in ("é", chr(0xE9 + 160)))
    assert seen > other + 5


def test_small_and_large_alphabets_give_the_same_trigrams(monkeypatch):
    words = ["the", "жук", "中文字", "\x00\x01", "😀a", "", "ééé"]
    small = q.distinct_trigrams([w.encode() for w in words])
    monkeypatch.setattr(q, "SMALL_ALPHABET", 0)
    for got, want in zip(small, q.distinct_trigrams([w.encode() for w in words])):
        assert got.tolist() == want.tolist()
    gram, lengths = q.trigrams([w.encode() for w in words])
    assert small[0][small[1]].tolist() == gram.tolist() and small[2].tolist() == lengths.tolist()
