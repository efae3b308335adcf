"""Longest prefixes and shortest extensions: a walk over sorted words, as over a trie.

For every request word of a space: the longest vocabulary word of that space that is a proper prefix of it,
and the shortest one that it is a proper prefix of (ties: the lower id). In sorted order the
words that are prefixes of a word form a stack, and the words that extend it follow it. So words
and requests are range-partitioned together on ``(space, word)`` and each range is walked once, with
a stack of open words. No prefix is ever written out, so the bytes moved are those of the words.

Ranges are joined at their ends. A first walk sums every range (of one space: a *run*) up in a few numbers: which
words of its own are prefixes of its last word, and what its words would offer to open
words of the runs before, by the number of characters they share with its first word. One task finds the
characters that neighbouring runs share; the driver hands the numbers on from run to run (a run has
a range and a space, so there are as many as both together), and the second walk starts from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexalign.functions.ranking import range_count
from lexalign.session import materialise

_SUMMARY = ("space bigint, range int, first string, last string, whole int, chain array<struct<len:int, idx:bigint>>, "
            "stairs array<struct<common:int, len:int, idx:bigint>>")
_FOUND = "space bigint, word string, short_idx bigint, short_len int, long_idx bigint"


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def _least(stairs: list[tuple]) -> list[tuple]:
    """The best ``(len, idx)`` for each number of shared characters, without those that a longer share beats."""
    out: list[tuple] = []
    for common, n, idx in sorted(stairs, key=lambda s: (-s[0], s[1], s[2])):
        if not out or (n, idx) < out[-1][1:]:
            out.append((common, n, idx))
    return out


class _Walk:
    """One run's words in order: vocabulary words (with an id) and requests (without)."""

    def __init__(self, chain=(), ahead=()):
        #: Prefixes from the runs before, ``(len, idx)``, the longest last; offers from those behind, ``(common, len, idx)``.
        self.chain, self.ahead = list(chain), list(ahead)
        self.open: list[list] = []            # [word, idx or None, best extension or None]
        self.first = self.last = None
        self.common, self.stairs = 0, []
        self.found: list[tuple] = []

    def word(self, word: str, idx: int | None) -> None:
        if self.first is None:
            self.first, self.common = word, len(word)
        elif self.common and not word.startswith(self.first[:self.common]):
            self.common = _shared(self.first[:self.common], word)
        self.last = word
        while self.open and not word.startswith(self.open[-1][0]):
            self._close()
        if idx is None and self.open and self.open[-1][0] == word:
            return                            # the request is in the vocabulary
        self.open.append([word, idx, None])
        if idx is not None:
            best = (len(word), idx)
            if len(self.open) > 1:            # the word below is shorter: it is extended by this one
                below = self.open[-2]
                below[2] = best if below[2] is None else min(below[2], best)
            self._offer(best)

    def _offer(self, best: tuple) -> None:
        if self.stairs and self.stairs[-1][0] == self.common:
            if best < self.stairs[-1][1:]:
                self.stairs[-1] = (self.common, *best)
        else:
            self.stairs.append((self.common, *best))

    def _close(self) -> None:
        word, idx, best = self.open.pop()
        if self.open and best is not None:    # what extends a word extends those below
            below = self.open[-1]
            below[2] = best if below[2] is None else min(below[2], best)
        if idx is None:
            short = next(((len(w), i) for w, i, _ in reversed(self.open) if i is not None), None)
            if short is None:
                shared = _shared(self.first, word)
                short = next(((n, i) for n, i in reversed(self.chain) if n <= shared and n < len(word)), None)
            if short or best:
                self.found.append((word, short[1] if short else None, short[0] if short else None, best[1] if best else None))

    def end(self) -> None:
        """Close all open words, with what the runs behind offer them."""
        for entry in self.open:
            offers = [(n, i) for common, n, i in self.ahead if common >= len(entry[0]) and n > len(entry[0])]
            if offers:
                entry[2] = min([*offers, entry[2]]) if entry[2] else min(offers)
        while self.open:
            self._close()

    def own_chain(self) -> list[tuple]:
        return [(len(w), i) for w, i, _ in self.open if i is not None]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(key, rows)`` where ``rows`` yields ``(word, idx)`` of one run after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, walk = None, None

    def out() -> pa.RecordBatch:
        row = {"space": key[0], "range": key[1], "first": walk.first, "last": walk.last, "whole": _shared(walk.first, walk.last),
               "chain": [{"len": n, "idx": i} for n, i in walk.own_chain()],
               "stairs": [{"common": c, "len": n, "idx": i} for c, n, i in _least(walk.stairs)]}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("space", pa.int64()), ("range", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.int32()),
            ("chain", pa.list_(pa.struct([("len", pa.int32()), ("idx", pa.int64())]))),
            ("stairs", pa.list_(pa.struct([("common", pa.int32()), ("len", pa.int32()), ("idx", pa.int64())])))]))

    for space, rng, word, idx in _runs(batches):
        if (space, rng) != key:
            if walk:
                yield out()
            key, walk = (space, rng), _Walk()
        walk.word(word, idx)
        walk.found.clear()
    if walk:
        yield out()


def _hand_on(runs: list) -> dict[tuple, tuple]:
    """For every run the chain it starts with and the offers it ends with; ``runs`` are in order."""
    states = {}
    chain: list[tuple] = []
    for r in runs:
        chain = [(n, i) for n, i in chain if n <= r["shared"]] if r["shared"] is not None else []
        states[r["space"], r["range"]] = (tuple(chain),)
        chain = [c for c in chain if c[0] <= r["whole"]] + [(c["len"], c["idx"]) for c in r["chain"]]
    ahead: list[tuple] = []
    for r, behind in zip(reversed(runs), [None, *reversed(runs)]):
        if behind is None or behind["shared"] is None:
            ahead = []
        else:
            offers = [(s["common"], s["len"], s["idx"]) for s in behind["stairs"]] + [(min(c, behind["whole"]), n, i) for c, n, i in ahead]
            ahead = _least([(min(c, behind["shared"]), n, i) for c, n, i in offers if min(c, behind["shared"]) > 0])
        states[r["space"], r["range"]] += (tuple(ahead),)
    return states


def prefix_search(requests: DataFrame, vocabulary: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(space, word, short_idx, short_len, long_idx)`` of the requests that have either.

    ``requests(space, word)`` are taken once each; ``vocabulary(space, word, idx)`` holds a word once a space.
    Requests that are in the vocabulary, and null words, have no row.
    """
    spark = requests.sparkSession
    both = vocabulary.select(F.col("space").cast("bigint").alias("space"), "word", F.col("idx").cast("bigint").alias("idx")) \
        .unionByName(requests.select(F.col("space").cast("bigint").alias("space"), "word", F.lit(None).cast("bigint").alias("idx")).distinct()) \
        .where(F.col("word").isNotNull() & (F.col("word") != ""))
    both = materialise(both, "prefix-input")
    n = ranges or range_count(both)
    # equal words fall into one range, the vocabulary's before the request
    dealt = materialise(both.repartitionByRange(n, "space", "word").withColumn("range", F.spark_partition_id()), "prefix-words")

    def walked() -> DataFrame:
        return dealt.repartition(n, "range").sortWithinPartitions("range", "space", "word", F.col("idx").asc_nulls_last()) \
            .select("space", "range", "word", "idx")

    before = F.lag("last").over(Window.partitionBy("space").orderBy("range"))       # a row a run
    ends = walked().mapInArrow(_summaries, _SUMMARY).withColumn("before", before)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [None if b is None else _shared(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(7).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 4, 5, 6)), pa.array(shared, pa.int32())],
                                             names=["space", "range", "whole", "chain", "stairs", "shared"])

    runs = ends.mapInArrow(share, "space bigint, range int, whole int, chain array<struct<len:int, idx:bigint>>, "
                                  "stairs array<struct<common:int, len:int, idx:bigint>>, shared int").collect()
    states = spark.sparkContext.broadcast(_hand_on(sorted(runs, key=lambda r: (r["space"], r["range"]))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, None

        def out() -> pa.RecordBatch:
            columns = list(zip(*walk.found)) if walk.found else [[]] * 4
            made = pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(walk.found), pa.int64()),
                 *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64())))],
                names=["space", "word", "short_idx", "short_len", "long_idx"])
            walk.found.clear()
            return made

        for space, rng, word, idx in _runs(batches):
            if (space, rng) != key:
                if walk:
                    walk.end()
                    yield out()
                key = (space, rng)
                walk = _Walk(*states.value[key])
            walk.word(word, idx)
            if len(walk.found) >= 10_000:
                yield out()
        if walk:
            walk.end()
            yield out()

    return walked().mapInArrow(search, _FOUND)
