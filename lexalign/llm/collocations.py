"""Phrase collocations: Rabin-Karp fingerprints of n-grams, verified against the text.

Texts are split into pieces at ``[.,;:!?]`` and line ends, pieces into words at blanks
and tabs, A-Z lower-cased. A phrase is two to ``MAX_WORDS`` words in a row within a
piece; it is a candidate if its language has it ``min_count`` times. All counts are
whole: nothing is sampled, and repeated texts count as often as they stand there.

Fingerprints. A numpy prefix polynomial over the bytes modulo 2^64 gives every word's hash
as a difference times an inverse power; a second one over the word hashes gives every
n-gram's. So a batch's n-grams cost a few array operations each, whatever their length.

Counting, from few to many words:

1. Words are counted exactly (per batch with Arrow, then by Spark).
2. Phrases of two, then of three frequent words are hashed and added up in the task and by Spark's shuffle as
   ``(fp, check, count, pointer)``. ``fp`` has 64 bits, ``check`` 16 more of an independent hash (of 10^8 frequent phrases
   among 10^13 distinct ones, one shares all 80 with another in a thousand corpora), and the pointer is the row
   of an occurrence. What reaches ``min_count`` stays.
3. The same for longer phrases, of which all runs of three words are frequent.
4. Verification. A row that pointers lead to is hashed once more, the places of its wanted fingerprints are found, and
   the words there are the key of the last count. Only these phrases ever become text.

"Frequent" in 2 and 3 is looked up in a bitmap of fingerprints of at most 2^``FILTER_BITS`` bits
(16 MB), which is broadcast. It may let infrequent ones through, never hold back a frequent one,
so it saves shuffling without touching the result; its size is bounded, so on corpora where
hundreds of millions of phrases are frequent it saves less.

Scores, per language with ``n`` words: each cut of a candidate with count ``a`` into parts counted ``l``
and ``r`` gives floor(1000 a n / (l r)), in 38-digit decimals; the lowest counts, ties to the first cut.
Parts of a candidate are frequent, so the joins find them all. A candidate is dropped if a longer candidate around it
has ``share`` percent of its count; as counts fall with length it is enough to look at one word more.

Defined results: a null text is empty; a null language is ``und``; texts are handled in stretches of
whole pieces, so a very long text is bounded by its longest piece; an empty table gives no rows; columns
besides language and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexalign.llm.common import mix64, seed64, session_for_text, shuffle_width, table, utf8, written

MIN_COUNT, MAX_WORDS, SHARE, TOP = 100, 5, 100, 2000
FILTER_BITS = 27
#: Bits of the bitmap for each frequent phrase, below its bound.
FILTER_SPARE = 64
#: Bytes of text hashed at once, and n-grams that a task holds.
STRETCH, HELD = 1 << 19, 3 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, dtype=np.uint8)         # 0 in a word, 1 between words, 2 between pieces
_CLASS[list(b" \t")] = 1
_CLASS[list(_BREAKS)] = 2
_LOWER_TABLE = bytes(_LOWER)


class Polynomial:
    """Prefix polynomials modulo 2^64 with an odd base: the hash of any range is a difference times an inverse power."""

    def __init__(self, name: str):
        self.base = seed64(name, "base") | 1
        self.bytes = np.array([seed64(name, i) for i in range(256)], dtype=np.uint64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            for which, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n + 1, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, which, np.multiply.accumulate(steps))

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        self.powers(len(values))
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def ranges(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefixes[end] - prefixes[start]) * self.down[start])


#: The fingerprint, and the second hash that keeps a task's n-grams apart.
FIRST, SECOND = Polynomial("phrase"), Polynomial("check")


class Stretch:
    """Words of some text: offsets of starts and ends, piece of each, and hashes under both polynomials."""

    def __init__(self, raw: np.ndarray, lang: str):
        self.lower = _LOWER[raw]
        kind = _CLASS[self.lower]
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        turn = np.diff(inside)
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.lang, self.hashed = lang, {}

    def word_prefixes(self, which: Polynomial) -> np.ndarray:
        if which not in self.hashed:
            words = which.ranges(which.prefixes(which.bytes[self.lower]), self.start, self.end)
            self.hashed[which] = which.prefixes(words)
        return self.hashed[which]

    def grams(self, which: Polynomial, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``n`` words from each place in ``at``; they differ by language and length."""
        return mix64(which.ranges(self.word_prefixes(which), at, at + n) ^ np.uint64(seed64("gram", self.lang, n)))

    def places(self, n: int) -> np.ndarray:
        """Where ``n`` words stand within one piece, as booleans by first word."""
        m = max(len(self.start) - n + 1, 0)
        return self.piece[:m] == self.piece[len(self.piece) - m:]


def stretches(raw: np.ndarray, limit: int = STRETCH) -> Iterator[tuple[int, np.ndarray]]:
    """``(offset, bytes)``: about ``limit`` bytes of whole pieces at a time."""
    at = 0
    while at < len(raw):
        size, end = limit, len(raw)
        while at + size < len(raw):
            breaks = np.flatnonzero(_CLASS[raw[at:at + size]] == 2)
            if len(breaks):
                end = at + int(breaks[-1]) + 1
                break
            size *= 2
        yield at, raw[at:end]
        at = end


def by_language(langs: list, texts: list[bytes]) -> Iterator[tuple[str, list[int]]]:
    rows: dict = {}
    for i, lang in enumerate(langs):
        if texts[i]:
            rows.setdefault(lang, []).append(i)
    yield from rows.items()


def count_words(keyed: DataFrame) -> DataFrame:
    """Partial ``(lang, word, c)`` of tasks; the row without a word has the number of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("c", "sum")]).rename_columns(["lang", "word", "c"])

        for batch in batches:
            texts, langs = utf8(batch.column(2)), batch.column(1).to_pylist()
            for lang, rows in by_language(langs, texts):
                raw = np.frombuffer(b"\n".join([texts[i] for i in rows]), dtype=np.uint8)
                for _, part in stretches(raw):
                    words = Stretch(part, lang)
                    if not len(words.start):
                        continue
                    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
                    values = pa.Array.from_buffers(pa.large_binary(), len(words.start), [
                        None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.lower[_CLASS[words.lower] == 0].tobytes())])
                    found = values.value_counts()
                    word, c = found.field(0), found.field(1)
                    held.append(pa.table({"lang": pa.array([lang] * (len(word) + 1), pa.string()),
                                          "word": pa.concat_arrays([word, pa.array([None], pa.large_binary())]),
                                          "c": pa.concat_arrays([c, pa.array([len(words.start)], pa.int64())])}))
                    size += len(word) * 16 + held[-1].nbytes
            if size > 64 << 20:
                held = [merged()]
                size = held[0].nbytes
                if size > 32 << 20:
                    yield from _words_out(held[0])
                    held, size = [], 0
        if held:
            yield from _words_out(merged())

    return keyed.mapInArrow(run, "lang string, word string, c long")


def _words_out(words: pa.Table) -> Iterator[pa.RecordBatch]:
    cast = words.set_column(1, "word", words.column("word").cast(pa.large_string()))
    yield from cast.to_batches(max_chunksize=1 << 16)


class Filter:
    """Bitmap of fingerprints: tells which may be frequent."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask = np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << max(bits - 3, 0), dtype=np.uint8)
        for at, block in blocks.items():
            raw = np.frombuffer(block, dtype=np.uint8)
            self.bitmap[at * len(raw):(at + 1) * len(raw)] = raw

    def may(self, fps: np.ndarray) -> np.ndarray:
        at = fps & self.mask
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def make_filter(fps: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """The bitmap of the column ``fp``; blocks of it are built by tasks, at most 2^(``most_bits`` - 3) bytes in all."""
    n = fps.count()
    bits = min(most_bits, max(16, (n * FILTER_SPARE).bit_length()))
    wide = min(bits, 20)

    def build(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        bitmap = np.zeros(1 << wide, dtype=bool)
        bitmap[at & ((1 << wide) - 1)] = True
        return pa.table({"block": pa.array([int(at[0]) >> wide], pa.int64()),
                         "bitmap": pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())})

    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    blocks = fps.select(at.alias("at")).distinct().withColumn("block", F.shiftright("at", wide)) \
        .groupBy("block").applyInArrow(build, "block long, bitmap binary")
    return Filter(bits, {r["block"]: bytes(r["bitmap"]) for r in blocks.collect()})


def word_fps(words: DataFrame, fp_bits: int = 64) -> DataFrame:
    """``fp`` of the words ``(lang, word)``, as :meth:`Stretch.grams` has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for lang, rows in by_language(langs, texts):
                s = Stretch(np.frombuffer(b"\n".join([texts[i] for i in rows]), dtype=np.uint8), lang)
                fp = s.grams(FIRST, 1, np.arange(len(s.start))) & np.uint64((1 << fp_bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], names=["fp"])

    return words.select("lang", "word").mapInArrow(run, "fp long")


class Held:
    """A task's n-grams ``(fp, check, row, count)``; the row is that of the first occurrence."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, fp: np.ndarray, check: np.ndarray, row: np.ndarray) -> None:
        self.parts.append((fp, check, row, np.ones(len(fp), dtype=np.uint32)))
        self.n += len(fp)

    def merge(self) -> None:
        fp, check, row, count = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        order = np.argsort(fp, kind="stable")
        new = self._new(fp, check, order)
        if (new & (fp[order][1:] == fp[order][:-1])).any():      # one fingerprint, different n-grams
            order = np.lexsort((check, fp))
            new = self._new(fp, check, order)
        head = np.flatnonzero(np.concatenate([[True], new]))
        first = order[head]
        self.parts = [(fp[first], check[first], row[first], np.add.reduceat(count[order], head).astype(np.uint32))]
        self.n = len(head)

    @staticmethod
    def _new(fp, check, order):
        a, b = fp[order], check[order]
        return (a[1:] != a[:-1]) | (b[1:] != b[:-1])

    def out(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Everything held, with the row ids of the task's documents."""
        if self.n:
            self.merge()
            for i in range(0, self.n, 1 << 15):
                fp, check, row, count = (c[i:i + (1 << 15)] for c in self.parts[0])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                    fp.view(np.int64), check.view(np.int16), count.astype(np.int64), rows[row])], names=["fp", "check", "c", "row"])
        self.parts, self.n = [], 0


def _hashes(s: Stretch, n: int, at: np.ndarray, keep: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return s.grams(FIRST, n, at) & keep, (s.grams(SECOND, n, at) >> np.uint64(48)).astype(np.uint16)


def count_grams(keyed: DataFrame, lengths: range, known: Filter, known_words: int, fp_bits: int = 64,
                held_grams: int = HELD) -> DataFrame:
    """Partial ``(fp, check, c, row)`` of tasks: phrases of ``lengths`` words of which every run of ``known_words`` may be known."""
    shared = keyed.sparkSession.sparkContext.broadcast(known)        # bounded: 2^FILTER_BITS bits
    keep = np.uint64((1 << fp_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, first = Held(), [], 0
        for batch in batches:
            row_ids, langs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist(), utf8(batch.column(2))
            for lang, at in by_language(langs, texts):
                parts = [texts[i] for i in at]
                begins = np.cumsum([0] + [len(p) + 1 for p in parts])
                rows.append(row_ids[at])
                for shift, part in stretches(np.frombuffer(b"\n".join(parts), dtype=np.uint8)):
                    s = Stretch(part, lang)
                    place = np.flatnonzero(s.places(known_words))
                    may = np.zeros(max(len(s.start) - known_words + 1, 0), dtype=bool)
                    may[place] = shared.value.may(_hashes(s, known_words, place, keep)[0])
                    document = np.searchsorted(begins, s.start + shift, side="right") - 1 + first
                    for n in range(known_words + 1, lengths.stop):
                        may = may[:-1] & may[1:] & s.places(n)
                        place = np.flatnonzero(may)
                        if not len(place):
                            break
                        if n in lengths:
                            held.add(*_hashes(s, n, place, keep), document[place].astype(np.uint32))
                first += len(at)
                if held.n > held_grams:
                    held.merge()
                    if held.n > held_grams // 4 * 3:
                        yield from held.out(np.concatenate(rows))
                        rows, first = [], 0
        if rows:
            yield from held.out(np.concatenate(rows))

    return keyed.mapInArrow(run, "fp long, check short, c long, row long")


def frequent(partials: DataFrame, min_count: int, name: str) -> DataFrame:
    """``(fp, check, c, row)`` of what is counted ``min_count`` times, with the first row, written once.

    The tasks have added up what they could, so rows are dealt by ``fp`` before Spark adds them up.
    """
    dealt = partials.repartition(shuffle_width(partials.sparkSession), "fp")
    return written(dealt.groupBy("fp", "check").agg(F.sum("c").alias("c"), F.min("row").alias("row"))
                   .where(F.col("c") >= min_count), name)


def rows_pointed_to(keyed: DataFrame, pointers: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows that pointers may point to: the others' texts need not be shuffled to the join."""
    may = make_filter(pointers.select(F.xxhash64("row").alias("fp")).distinct(), filter_bits)
    known = keyed.sparkSession.sparkContext.broadcast(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = known.value.may(batch.column(3).to_numpy().view(np.uint64))
            if found.any():
                yield batch.filter(pa.array(found)).select(["row", "lang", "text"])

    return keyed.withColumn("fp", F.xxhash64("row")).mapInArrow(run, "row long, lang string, text string")


def point_out(keyed: DataFrame, pointers: DataFrame, max_words: int, fp_bits: int = 64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, phrase, words, c)``: the words that pointers ``(fp, check, c, row)`` stand for."""
    keep = np.uint64((1 << fp_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases, counts = [], [], []
            for lang, text, found in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                wanted = {(p["fp"], p["check"]): p["c"] for p in found}
                fps = np.array([p["fp"] for p in found], dtype=np.int64).view(np.uint64)
                for _, part in stretches(np.frombuffer(text, dtype=np.uint8)):
                    s = Stretch(part, lang)
                    for n in range(2, max_words + 1):
                        place = np.flatnonzero(s.places(n))
                        fp, check = _hashes(s, n, place, keep)
                        for i in np.flatnonzero(np.isin(fp, fps)).tolist():
                            c = wanted.pop((int(fp[i:i + 1].view(np.int64)[0]), int(check[i:i + 1].view(np.int16)[0])), None)
                            if c is not None:
                                words = s.lower[s.start[place[i]]:s.end[place[i] + n - 1]].tobytes().split()
                                langs.append(lang)
                                phrases.append(b" ".join(words).decode())
                                counts.append(c)
                if wanted:
                    raise ValueError("a row is not the one that was counted: the table must be written first (copy=True)")
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(phrases, pa.string()),
                 pa.array([p.count(" ") + 1 for p in phrases], pa.int32()), pa.array(counts, pa.int64())],
                names=["lang", "phrase", "words", "c"])

    by_row = pointers.groupBy("row").agg(F.collect_list(F.struct("fp", "check", "c")).alias("found"))   # bounded by the text
    return rows_pointed_to(keyed, pointers, filter_bits).join(by_row, "row").select("lang", "text", "found") \
        .mapInArrow(run, "lang string, phrase string, words int, c long")


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang",
                  text_col: str = "text", fp_bits: int = 64, filter_bits: int = FILTER_BITS,
                  held_grams: int = HELD, copy: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, a)`` of all words and phrases counted ``min_count`` times, and ``(lang, n)``.

    Pointers are running numbers of rows. A table of files is numbered alike by every scan, so ``copy=False`` may spare it
    the written copy that other inputs need; pointers that do not lead to their phrase are an error.
    """
    spark = docs.sparkSession
    session_for_text(spark)
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(lang_col, F.lit("und")).alias("lang"),
                        F.col(text_col).alias("text"))
    keyed = written(keyed, "phrase-rows") if copy else keyed
    counted = written(count_words(keyed).groupBy("lang", "word").agg(F.sum("c").alias("a"))
                      .where((F.col("a") >= min_count) | F.col("word").isNull()), "phrase-words")
    words = counted.where("word is not null")
    totals = counted.where("word is null").select("lang", F.col("a").alias("n"))
    word_filter = make_filter(word_fps(words, fp_bits), filter_bits)
    options = {"fp_bits": fp_bits, "held_grams": held_grams}
    pointers = None
    for n in range(2, min(max_words, 3) + 1):       # one after the other, so that one shuffle is held at a time
        one = frequent(count_grams(keyed, range(n, n + 1), word_filter, 1, **options), min_count, f"phrases-{n}")
        pointers = one if pointers is None else pointers.unionByName(one)
    if max_words > 3:
        triples = make_filter(one.select("fp").distinct(), filter_bits)
        pointers = pointers.unionByName(
            frequent(count_grams(keyed, range(4, max_words + 1), triples, 3, **options), min_count, "phrases-long"))
    exact = point_out(keyed, pointers, max_words, fp_bits, filter_bits).groupBy("lang", "phrase", "words") \
        .agg(F.sum("c").alias("a")).where(F.col("a") >= min_count)
    phrases = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a").unionByName(exact)
    return written(phrases, "phrases"), totals


def score_phrases(phrases: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """Scores of the candidates that no longer candidate holds, from all frequent words and phrases."""
    known = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias("_f"))
    candidates = phrases.where("words > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)")) \
        .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    for part, out in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(known, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))) \
            .withColumn(out, F.col("_f")).drop("_lang", "_part", "_f")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    exact = cuts.join(F.broadcast(totals), "lang") if _few(totals) else cuts.join(totals, "lang")
    scored = exact.withColumn("up", wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide["l"] * wide["r"]) \
        .withColumn("score", F.expr("up div down")) \
        .groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = candidates.where("words > 2").select("lang", "a", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    return scored.join(around, ["lang", "phrase"], "left") \
        .where(F.col("around").isNull() | (F.col("around").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share)) \
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _few(totals: DataFrame, most: int = 10_000) -> bool:
    return len(totals.limit(most + 1).collect()) <= most


def mine_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase (UTF-8 order)."""
    phrases, totals = count_phrases(docs, **options)
    scored = written(score_phrases(phrases, totals), "phrase-scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))          # a language's rows may be most of all: two rounds
    first = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language of all documents."""
    return mine_collocations(table(spark, sf_dir, "documents"), copy=False)


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, words, unnest([array_to_string(w[i : i + words - 1], ' ') for i in range(1, len(w) - words + 2)]) AS phrase
  FROM worded, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS words)),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
freq AS (SELECT lang, phrase, words, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, t.n, k, x.a AS l, y.a AS r, (1000 * c.a * t.n) // (x.a * y.a) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM freq WHERE words > 1) c
  JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.words], ' ')
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM freq f WHERE f.lang = b.lang AND f.words > b.words AND 100 * f.a >= {SHARE} * b.a
      AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
WHERE rank <= {TOP}
"""
