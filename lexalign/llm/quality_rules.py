"""Quality rules: word counts, repetition, and bands of n-gram perplexity.

The model is a modified Kneser-Ney model of character trigrams within words, one
for each language. Spark counts the trigrams: a task counts words, cuts the
distinct ones into trigrams and reports sums, so little is shuffled. A character
is its code point, and a word's end is one more; no two characters share a count.
A trigram is a 63-bit number; it serves as its own hash. A language's model is a sorted array of those numbers
beside one of log probabilities, and sorted arrays for the lower orders: as many entries as the language has
distinct trigrams, which grow far slower than its texts.

A document's log perplexity is that of its words, per predicted character (the end
of each word is predicted too). A word's probability is a mixture of fixed weights: its own language's
and, by ``POOLED``, the whole corpus's, so that quoted foreign words cost something, but not everything. All documents that pass the base rules enter an exact histogram
for each language, whose median and median absolute deviation set a lower and an upper
band; short texts get wider ones, as their mean scatters more. The model is fitted
twice: the second fit counts what the first one's bands accept. Outside the second
one's bands a document is rejected.

Each distinct text of a language counts once, in both fits and in the histogram, so that
a group of copies of any size decides no more than one text does; every row is judged.
Only texts with copies are shuffled to find the distinct ones: a bitmap of hashes tells
which may have some. The scatter of a language has a floor, as texts of like content
(near-copies are distinct texts here) can bring the deviation down to nothing.

Models are broadcast in groups of languages of ``MODEL_ENTRIES`` at most, each group
scoring its own languages' rows, so the broadcast is bounded at any number of languages.

Defined results: a null text has no words and fails the base rules; a null language is
a language of its own; repeated rows are judged each and counted once; null ids are kept;
an empty table gives an empty result; a language without accepted texts has the pooled
model alone, and where nothing is accepted at all each character is as likely as another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.common import arrow_rows, drop_worker_cache, free_memory, hashes, mix64, session_for_text, table, utf8, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Every code point, and a word's end.
CHAR_BITS = 21
CLASSES = 1 << CHAR_BITS
#: Weight of the whole corpus's model in the probability of a word.
POOLED = 0.2
#: Bands: deviations below and above the median, in units of the scatter.
LOWER, UPPER = 6.0, 3.0
#: The same for the texts that the second model is counted from.
TRIM_LOWER, TRIM_UPPER = 3.0, 1.0
#: Scatter of a text's mean: this by the root of its characters is added to the language's.
CHAR_SCATTER = 1.0
#: The least scatter of a language.
LEAST_SCATTER = 0.02
BIN = 0.002
#: Words of 64 bits in the bitmap of the hashes of repeated texts.
SLOT_WORDS = 1 << 19
#: Bytes of texts whose words are handled at once; a longer text is handled by itself.
STRETCH = 1 << 20
#: Trigrams that a task holds for a language.
HELD_GRAMS = 1 << 19
#: Alphabet whose trigrams are told apart as 32-bit numbers within a stretch.
SMALL_ALPHABET = 1290
#: Trigrams of one broadcast of models.
MODEL_ENTRIES = 1 << 21

_INSIDE = np.ones(256, dtype=bool)
_INSIDE[list(BLANKS)] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def classes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each word followed by its end (0), and the lengths with it.

    No word has a line feed, so its number stands for the code point 0.
    """
    text = (b"\n".join(words) + b"\n").decode("utf-8", "replace")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    end = code == 10
    code[code == 0] = 10
    code[end] = 0
    ends = np.flatnonzero(end) + 1
    return code, np.diff(np.r_[0, ends])


def _joined(c: np.ndarray, base: int) -> np.ndarray:
    """Each number with the two before it in its word, as one number of that base."""
    before = np.r_[c[:1] * 0, c[:-1]]
    first = np.r_[c[:1] * 0, before[:-1]]
    first[before == 0] = 0
    return (first * base + before) * base + c


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One trigram for each character and end of the words, and the lengths of the words' runs."""
    c, lengths = classes(words)
    return _joined(c.astype(np.int64), CLASSES), lengths


def distinct_trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of the words, the place of each one's among them, and the lengths of the words' runs.

    With few characters the trigrams are sorted as 32-bit numbers of their places in the alphabet, which keep the order.
    """
    c, lengths = classes(words)
    seen = np.zeros(CLASSES, dtype=bool)
    seen[0] = True
    seen[c] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) > SMALL_ALPHABET:
        return (*np.unique(_joined(c.astype(np.int64), CLASSES), return_inverse=True), lengths)
    place = np.zeros(alphabet[-1] + 1, dtype=np.int32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    used, at = np.unique(_joined(place[c], len(alphabet)), return_inverse=True)
    rest, last = np.divmod(used, len(alphabet))
    first, before = np.divmod(rest, len(alphabet))
    return (alphabet[first] * CLASSES + alphabet[before]) * CLASSES + alphabet[last], at, lengths


class Words:
    """The words of some texts as numbers of their distinct words, found with numpy and Arrow."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        inside = _INSIDE[raw]
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        large = len(raw) >= 1 << 31
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64 if large else np.int32)
        words = pa.Array.from_buffers(pa.large_binary() if large else pa.binary(), len(start), [
            None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.distinct = words.dictionary.to_pylist()
        self.number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.searchsorted(self.begins, start, side="right") - 1
        self.n = np.bincount(self.text, minlength=len(texts))
        self.raw = raw
        self._grams = None

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct trigrams of the distinct words, the place of each word's among them, and the words' lengths."""
        if self._grams is None:
            self._grams = distinct_trigrams(self.distinct) if self.distinct else (np.zeros(0, np.int64),) * 3
        return self._grams

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Sums over each text of what each distinct word has."""
        return np.bincount(self.text, weights=of_word[self.number], minlength=len(self.texts)) if len(self.number) else np.zeros(len(self.texts))

    def chars(self) -> np.ndarray:
        """Code points in the words of each text."""
        return self.sums(self.grams()[2] - 1).astype(np.int64)

    def symbols(self) -> np.ndarray:
        at = np.flatnonzero(_SYMBOL[self.raw])
        return np.bincount(np.searchsorted(self.begins, at, side="right") - 1, minlength=len(self.texts))

    def repeated(self) -> np.ndarray:
        """Words of each text in three-word windows that it has twice or more."""
        m = max(len(self.number) - 2, 0)
        whole = np.flatnonzero(self.text[:m] == self.text[2:]) if m else np.zeros(0, dtype=np.int64)
        a, b, c, d = (self.number[whole], self.number[whole + 1], self.number[whole + 2], self.text[whole]) if m else [whole] * 4
        key = mix64(mix64(mix64(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
                          ^ (c.astype(np.uint64) << np.uint64(32) | d.astype(np.uint64))))
        order = np.argsort(key)

        def equal(order: np.ndarray) -> np.ndarray:
            i, j = order[1:], order[:-1]
            return (a[i] == a[j]) & (b[i] == b[j]) & (c[i] == c[j]) & (d[i] == d[j])
        same = equal(order)
        if len(order) and (same != (key[order][1:] == key[order][:-1])).any():       # a hash that two windows share
            order = np.lexsort((c, b, a, d))
            same = equal(order)
        again = np.zeros(len(whole), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(self.number), dtype=bool)
        for i in range(3):
            covered[whole[again] + i] = True
        return np.bincount(self.text[covered], minlength=len(self.texts))

    def duplicate_lines(self) -> np.ndarray:
        out = []
        for text in self.texts:
            lines = text.split(b"\n")
            if len(set(lines)) < len(lines):
                lines = [x for x in lines if x.strip(BLANKS)]
                out.append(len(lines) - len(set(lines)))
            else:
                out.append(0)
        return np.array(out, dtype=np.int64)

    def gram_counts(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of the words of the ``counted`` texts, and their sums."""
        used, at, lengths = self.grams()
        times = np.bincount(self.number[counted[self.text]], minlength=len(self.distinct))
        n = np.bincount(at, weights=np.repeat(times, lengths), minlength=len(used)).astype(np.int64)
        return used[n > 0], n[n > 0]


def summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order with the sums of their counts; none without a count."""
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(n, head) if len(head) else n
    return gram[head][sums > 0], sums[sums > 0]


def in_stretches(langs: list, texts: list[bytes]) -> Iterator[tuple[str | None, list[int], Words]]:
    """``(language, rows, words)`` of a batch: texts of one language, about ``STRETCH`` bytes at a time."""
    rows: dict = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, mine in rows.items():
        held, size = [], 0
        for i in mine:
            if held and size + len(texts[i]) > STRETCH:
                yield lang, held, Words([texts[k] for k in held])
                held, size = [], 0
            held.append(i)
            size += len(texts[i])
        if held:
            yield lang, held, Words([texts[k] for k in held])


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if np.all((d[1:] > 0) & (d[1:] < np.arange(1, 4))) else np.array([0.0, 0.5, 1.0, 1.5])


def _places(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers in a sorted array, and which of them are there."""
    if not len(sorted_):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class _Level:
    """Interpolated probabilities of one order: what was counted, and what each context leaves to the lower order."""

    def __init__(self, context: np.ndarray, n: np.ndarray, lower: np.ndarray):
        gone = discounts(n)[np.minimum(n, 3)]
        self.contexts, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, weights=n, minlength=len(self.contexts))
        self.left = np.bincount(of, weights=gone, minlength=len(self.contexts)) / total
        self.p = (n - gone) / total[of] + self.left[of] * lower

    def leaves(self, context: np.ndarray) -> np.ndarray:
        """The share of the lower order after each context: all, where the context was never seen."""
        at, there = _places(self.contexts, context)
        out = np.ones(len(context))
        out[there] = self.left[at[there]]
        return out


class Model:
    """Log probabilities of trigrams: sorted numbers with their values, and what lower orders leave."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        self.gram, n = np.asarray(gram, dtype=np.int64)[order], n[order]
        pair = self.gram & ((1 << 2 * CHAR_BITS) - 1)
        # lower orders count distinct left neighbours; word starts have none, so they keep their counts
        starts = (self.gram >> CHAR_BITS) == 0
        self.pair, at = np.unique(pair, return_inverse=True)
        c2 = np.bincount(at, weights=np.where(starts, n, 1), minlength=len(self.pair)).astype(np.int64)
        self.last, at1 = np.unique(self.pair & (CLASSES - 1), return_inverse=True)
        c1 = np.bincount(at1, minlength=len(self.last))
        self.one = _Level(np.zeros(len(self.last), dtype=np.int64), c1, 1 / CLASSES)
        self.two = _Level(self.pair >> CHAR_BITS, c2, self.one.p[at1])
        self.three = _Level(self.gram >> CHAR_BITS, n, self.two.p[at])
        self.logp = np.log(self.three.p).astype(np.float32)
        self.three.p = None

    def _one(self, last: np.ndarray) -> np.ndarray:
        at, there = _places(self.last, last)
        out = self.one.leaves(np.zeros(len(last), dtype=np.int64)) / CLASSES
        out[there] = self.one.p[at[there]]
        return out

    def _two(self, pair: np.ndarray) -> np.ndarray:
        at, there = _places(self.pair, pair)
        out = np.zeros(len(pair))
        out[there] = self.two.p[at[there]]
        miss = pair[~there]
        out[~there] = self.two.leaves(miss >> CHAR_BITS) * self._one(miss & (CLASSES - 1))
        return out

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        """Log probability of each trigram's last character after the others."""
        gram = np.asarray(gram, dtype=np.int64)
        at, there = _places(self.gram, gram)
        logp = np.zeros(len(gram))
        logp[there] = self.logp[at[there]]
        miss = gram[~there]
        logp[~there] = np.log(self.three.leaves(miss >> CHAR_BITS) * self._two(miss & ((1 << 2 * CHAR_BITS) - 1)))
        return logp


def failed_base(n_words, n_repeated):
    return (n_words < MIN_WORDS) | (100 * n_repeated > MAX_REPEATED_PERCENT * n_words)


class Models:
    """The models of a group of languages, and the pooled one of all."""

    def __init__(self, models: dict[str | None, Model], pooled: Model):
        self.models, self.pooled = models, pooled

    def log_probability(self, lang: str | None, words: Words) -> np.ndarray:
        """Log probability of the words of each text, with their ends: each word's is the mixture of both models."""
        if not words.distinct:
            return np.zeros(len(words.texts))
        used, at, lengths = words.grams()
        first = np.cumsum(lengths) - lengths
        pooled = np.add.reduceat(self.pooled.log_probability(used)[at], first)
        own = self.models.get(lang)
        if own is None:
            return words.sums(pooled)
        mine = np.add.reduceat(own.log_probability(used)[at], first)
        return words.sums(np.logaddexp(np.log1p(-POOLED) + mine, np.log(POOLED) + pooled))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(lang, text)`` with each distinct pair once.

    Pairs whose hash no other row has pass by; those that may have copies (a bit of a bitmap says
    so, for some single ones as well) go through a shuffle, and the distinct ones are written.
    """
    hashed = rows.select("lang", "text", F.pmod(F.xxhash64("lang", "text"), F.lit(64 * SLOT_WORDS)).alias("slot"),
                         F.xxhash64(F.lit(1), "lang", "text").alias("hash"))
    word, bit = F.expr("shiftright(slot, 6)"), F.expr("shiftleft(1L, cast(slot & 63 as int))")
    repeated = hashed.groupBy("slot", "hash").count().where("count > 1")
    bitmap = written(repeated.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "repeated-texts")
    marked = hashed.join(F.broadcast(bitmap), word == F.col("word"), "left") \
        .withColumn("again", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    copies = written(marked.where("again").select("lang", "text").distinct(), "distinct-texts")
    return marked.where("not again").select("lang", "text").unionAll(copies)


def count_trigrams(rows: DataFrame, models=None, accepted=None) -> DataFrame:
    """``(lang, gram, n)`` over the words of the texts ``(lang, text)`` that pass the base rules.

    With broadcast models and the bands ``accepted`` by language, only texts inside them count.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        held: dict = {}

        def out(lang) -> pa.RecordBatch:
            gram, n = summed(*(np.concatenate(c) for c in zip(*held.pop(lang))))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()),
                                               pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, _, words in in_stretches(batch.column(0).to_pylist(), utf8(batch.column(1))):
                counted = ~failed_base(words.n, words.repeated())
                if models:
                    chars = words.chars() + words.n
                    low, high = accepted.value[lang].limits(chars, TRIM_LOWER, TRIM_UPPER) if lang in accepted.value else (0.0, 0.0)
                    perplexity = -models.value.log_probability(lang, words) / np.maximum(chars, 1)
                    counted &= (low <= perplexity) & (perplexity <= high)
                if counted.any():
                    parts = held.setdefault(lang, [])
                    parts.append(words.gram_counts(counted))
                    if sum(len(g) for g, _ in parts) > HELD_GRAMS:
                        parts[:] = [summed(*(np.concatenate(c) for c in zip(*parts)))]
                        if len(parts[0][0]) > HELD_GRAMS // 2:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)
        free_memory()

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


SCORED = ("doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, lang string, log_perplexity double, hash_a long, hash_b long")


def score(rows: DataFrame, models) -> DataFrame:
    """Base counts, log perplexity (null without words) and text hashes of the rows ``(doc_id, lang, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), utf8(batch.column(2))
            numbers = np.zeros((5, len(texts)), dtype=np.int64)
            logp = np.full(len(texts), np.nan)
            for lang, rows, words in in_stretches(langs, texts):
                chars = words.chars()
                numbers[:, rows] = words.n, chars, words.symbols(), words.duplicate_lines(), words.repeated()
                some = words.n > 0
                logp[np.array(rows)[some]] = (-models.value.log_probability(lang, words) / np.maximum(chars + words.n, 1))[some]
            failed = failed_base(numbers[0], numbers[4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, numbers), pa.array(failed), batch.column(1),
                 pa.array(logp, mask=np.isnan(logp)), *batch.columns[3:]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "lang", "log_perplexity", "hash_a", "hash_b"])
        free_memory()

    a, b = hashes("text")
    hashed = rows.select("doc_id", "lang", "text", a.alias("hash_a"), b.alias("hash_b"))
    return hashed.mapInArrow(run, SCORED.format(id=rows.schema["doc_id"].dataType.simpleString()))


def language_groups(counts: DataFrame) -> list[list[str | None]]:
    """Languages in groups of ``MODEL_ENTRIES`` model entries at most (or one language)."""
    groups: list[list] = [[]]
    held = 0
    for r in counts.groupBy("lang").count().orderBy("lang").collect():       # a row a language
        if groups[-1] and held + r["count"] > MODEL_ENTRIES:
            groups.append([])
            held = 0
        groups[-1].append(r["lang"])
        held += r["count"]
    return groups


def fit(counts: DataFrame, langs: list[str | None]):
    """Broadcast models of a group of languages, and the pooled one: an entry a distinct trigram."""
    spark = counts.sparkSession
    with arrow_rows(spark, 10_000):
        own = counts.where(_is_one_of(langs)).toPandas()
        pooled = counts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    models = {}
    for lang in langs:
        mine = own[own["lang"].isna()] if lang is None else own[own["lang"] == lang]
        if len(mine):                                                        # else the pooled model alone
            models[lang] = Model(mine["gram"].to_numpy(np.int64), mine["n"].to_numpy(np.int64))
    return spark.sparkContext.broadcast(
        Models(models, Model(pooled["gram"].to_numpy(np.int64), pooled["n"].to_numpy(np.int64))))


def _is_one_of(langs: list[str | None]):
    return reduce(lambda a, b: a | b, [F.col("lang").eqNullSafe(F.lit(x)) for x in langs], F.lit(False))


class Band:
    """Median and scatter of a language's log perplexity; short texts scatter more."""

    def __init__(self, median: float, scatter: float):
        self.median, self.scatter = median, scatter

    def limits(self, chars, lower: float, upper: float) -> tuple:
        width = self.scatter + CHAR_SCATTER / (chars + 1) ** 0.5
        return self.median - lower * width, self.median + upper * width


def _quantile(values: np.ndarray, weights: np.ndarray) -> float:
    """Weighted median."""
    order = np.argsort(values, kind="stable")
    at = np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)
    return float(values[order][at])


def bands(scored: DataFrame) -> dict[str | None, Band]:
    """The band of each language, from an exact histogram of its distinct texts, of bounded size."""
    bin_ = F.floor(F.least(F.col("log_perplexity"), F.lit(40.0)) / BIN).cast("int")
    texts = scored.where("not base_failed").groupBy("lang", "hash_a", "hash_b").agg(F.min(bin_).alias("bin"))
    histogram = texts.groupBy("lang", "bin").count().collect()
    by_lang: dict[str | None, list] = {}
    for r in histogram:
        by_lang.setdefault(r["lang"], []).append(((r["bin"] + 0.5) * BIN, r["count"]))
    out = {}
    for lang, cells in by_lang.items():
        x, n = (np.array(c, dtype=np.float64) for c in zip(*cells))
        middle = _quantile(x, n)
        out[lang] = Band(middle, max(LEAST_SCATTER, 1.4826 * _quantile(np.abs(x - middle), n)))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Base counts, log perplexity, its bands, the verdict and text hashes of every row.

    Two fits: the first model sets bands, and the second is counted from the texts
    inside them, so that what the rules are to reject does not teach the model.
    """
    spark = docs.sparkSession
    session_for_text(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = distinct_texts(rows)
    counts = written(count_trigrams(texts), "trigrams")
    groups = language_groups(counts)

    def by_group(rows: DataFrame, counts: DataFrame, run: Callable) -> DataFrame:
        """``run(rows, models)`` over the rows of each group of languages; the last has all other rows as well."""
        parts = []
        for i, langs in enumerate(groups):
            rest = reduce(lambda a, b: a & b, [~_is_one_of(g) for g in groups[:i]], F.lit(True))
            mine = rest if i == len(groups) - 1 else _is_one_of(langs)
            parts.append(run(rows if len(groups) == 1 else rows.where(mine), fit(counts, langs)))
        return reduce(DataFrame.unionAll, parts)

    first = written(by_group(rows, counts, score), "quality-first")
    accepted = spark.sparkContext.broadcast(bands(first))
    again = written(by_group(texts, counts, lambda part, models: count_trigrams(part, models, accepted)),
                    "trigrams-again")
    scored = written(by_group(rows, again, score), "quality")
    limits = spark.createDataFrame([(k, v.median, v.scatter) for k, v in bands(scored).items()],
                                   "band_lang string, median double, scatter double")
    joined = scored.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    width = F.col("scatter") + CHAR_SCATTER / F.sqrt(F.col("word_chars") + F.col("n_words") + 1)
    inside = F.col("log_perplexity").between(F.col("median") - LOWER * width, F.col("median") + UPPER * width)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "log_perplexity")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the rules reject go; a verdict is of a language and a text, whatever the id."""
    bad = judge(docs).where("not kept").select(F.col("lang").alias("_lang"), "hash_a", "hash_b").distinct()
    a, b = hashes("text")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_a") == F.col("hash_a")) & (F.col("_b") == F.col("hash_b"))
    return docs.withColumn("_a", a).withColumn("_b", b).join(bad, same, "left_anti").select(docs.columns)
