"""Mixing sources to target weights by temperature.

A source with the share ``p`` of all tokens gets the weight ``p ** a``, normalised. At
``a = 1`` sources keep their shares, at ``a = 0`` all weigh the same. The exponent is
bisected: to reach a target entropy, or to the flattest mix in which no source is
repeated more than ``max_epochs`` times. The budget in tokens is given, or is the
smallest that uses every document at least once.

The weights become rows by block permutations. Each source's documents are dealt
into blocks of about ``BLOCK_TOKENS`` by a hash of the row. Every epoch puts the source's blocks, and the documents
of each block, into a new random order: ``block_at`` and ``doc_at``, hashes of the epoch's number, so that rows in the order of
``(copy, block_at, doc_at)`` are the permuted blocks one after the other. A source that gets ``e`` whole
epochs and a rest of its budget yields all its documents ``e`` times; of the last epoch it yields the
blocks that come first, while they fit; the block in which the budget ends gives its documents in their order, as long as
they fit.

Only sums by source and by block are shuffled. The plan has one row a source: the
whole epochs and where the last one stops (the hash of a block and of a document), so
choosing rows is a comparison beside a small join, and texts stay where they are.
Where the budget of a source ends is found by narrowing: sums by the first twelve bits of the blocks' places, then by the next
twelve of the range that holds the end, then by block. No window is over more than 4,096 sums, one source's
blocks of a sixteen-millionth part of their places, or the documents of one block.

Tokens are those of a tokenizer's file, or, without one, words between blanks, unless a column holds their number.

Defined results: a null source is a source; a null text or number counts as no
tokens, and a document without tokens comes along whenever its place is within the
budget; sources without tokens are in no mix but keep their rows once; a row's place depends on its id, text and number of
tokens, so rows that share or lack an id are dealt like others, and only rows with all of them equal are
drawn together, as are ties of hashes; an empty table gives an
empty result. ``copy`` (the epoch), ``block``, ``block_at`` and ``doc_at`` are added to the columns; columns of the input with these
names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexalign.llm.batch_tokens import ROWS, batch_encoder
from lexalign.llm.common import free_memory, hashes, session_for_text, table, utf8, written
from lexalign.llm.tokens import default_path

BLOCK_TOKENS = 1 << 16
MAX_EPOCHS = 1.5
SEED = 17


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised ``shares ** exponent``; sources without tokens stay at zero."""
    powered = np.where(shares > 0, np.power(np.where(shares > 0, shares, 1.0), exponent), 0.0)
    return powered / powered.sum()


def _bisect(ok, steps: int = 60) -> float:
    """Smallest exponent in [0, 1] for which ``ok`` holds; ``ok`` turns true once."""
    if ok(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if ok(middle) else (middle, high)
    return high


def solve_weights(tokens: np.ndarray, budget: float | None = None, max_epochs: float | None = MAX_EPOCHS,
                  target_entropy: float | None = None) -> tuple[np.ndarray, float, float]:
    """Weights, exponent and budget for sources of ``tokens``.

    With a target entropy the exponent is the largest that reaches it; a limit of epochs
    may then raise the exponent further. Without a budget every source is used once
    at least.
    """
    tokens = np.asarray(tokens, dtype=float)
    used = tokens > 0
    if not used.any():
        return np.zeros(len(tokens)), 1.0, 0.0
    shares = tokens / tokens.sum()

    def total(w: np.ndarray) -> float:
        return float((tokens[used] / w[used]).max()) if budget is None else float(budget)

    def within(exponent: float) -> bool:
        w = tempered(shares, exponent)
        return max_epochs is None or float((w[used] * total(w) / tokens[used]).max()) <= max_epochs * (1 + 1e-12)

    exponent = 1.0
    if target_entropy is not None:      # entropy falls as the exponent grows
        exponent = _bisect(lambda a: entropy(tempered(shares, a)) <= target_entropy)
    elif max_epochs is not None:
        exponent = _bisect(within)
    if target_entropy is not None and not within(exponent):
        exponent = max(exponent, _bisect(within))
    w = tempered(shares, exponent)
    goal = total(w)
    if max_epochs is not None:          # a budget that no mix can fill within the limit
        goal = min(goal, max_epochs * float(tokens.sum())) if budget is not None else goal
    return w, exponent, goal


#: Columns that the mix adds.
PLACES = ("copy", "block", "block_at", "doc_at")


def with_tokens(keyed: DataFrame, path: str | None = None) -> DataFrame:
    """Number of tokens of the rows ``(_key, _source, _text)``, as ``_tokens``; the text is not copied into Python's output."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            texts = utf8(batch.column(2))
            n = [len(ids) // 2 for ids in batch_encoder(path).encode(texts, "<u2")] if path else [len(t.split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["_key", "_source", "_tokens"])
        if path:
            batch_encoder(path).forget()
        free_memory()
    return keyed.select("_key", "_source", "_text").mapInArrow(count, "_key long, _source string, _tokens long")


def _order(turn, what: str, *columns: str):
    """A random place: the hash of a permutation's number and a key."""
    return F.xxhash64(F.lit(SEED), F.lit(what), turn, *columns)


def _end(rows: DataFrame, place) -> DataFrame:
    """``(s, at, left)``: the place, of those of a source's rows ``(source, rest, n)``, in which ``rest`` is passed, and what is left there."""
    sums = rows.groupBy("source", "rest", place.alias("at")).agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("end", so_far).where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("n") <= F.col("rest"))) \
        .groupBy("source").agg(F.min(F.struct("at", (F.col("rest") - F.col("end") + F.col("n")).alias("left"))).alias("b")) \
        .select(F.col("source").alias("s"), "b.at", "b.left")


def _inside(rows: DataFrame, found: DataFrame, place) -> DataFrame:
    """The rows at the found places of their sources, with what is left there as ``rest``."""
    same = F.col("source").eqNullSafe(F.col("s")) & (place == F.col("at"))
    return rows.drop("rest").join(F.broadcast(found), same).withColumnRenamed("left", "rest").drop("s", "at")      # a row a source


def mixing_plan(keyed: DataFrame, budget: float | None = None, max_epochs: float | None = MAX_EPOCHS,
                target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a source from the rows ``(_key, _source, _tokens)``.

    ``(source, tokens, weight, exponent, epochs, blocks, last_block, last_doc)``: the last epoch
    takes blocks placed before ``last_block``, and of that block what is placed up to ``last_doc``.
    """
    spark = keyed.sparkSession
    sums = keyed.groupBy("_source").agg(F.sum("_tokens").alias("n")).orderBy("_source").collect()     # a row a source
    tokens = np.array([r["n"] or 0 for r in sums], dtype=float)
    weights, exponent, goal = solve_weights(tokens, budget, max_epochs, target_entropy)
    rows = []
    for r, n, w in zip(sums, tokens, weights):
        share = int(round(w * goal))
        epochs = int(share // n) if n else 1
        rows.append((r["_source"], int(n), float(w), exponent, epochs, max(1, -(-int(n) // block_tokens)),
                     int(share - epochs * n) if n else 0))
    plan = spark.createDataFrame(rows, "source string, tokens long, weight double, exponent double, epochs int, "
                                       "blocks long, rest long")
    placed = keyed.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("source"))).where("rest > 0") \
        .withColumn("block", F.pmod(F.xxhash64("_key", F.lit(SEED)), F.col("blocks"))) \
        .withColumn("block_at", _order(F.col("epochs"), "block", "block")) \
        .withColumn("doc_at", _order(F.col("epochs"), "doc", "_key")) \
        .select("source", "rest", "block_at", "doc_at", F.col("_tokens").alias("n"))
    coarse, fine = F.shiftright("block_at", 52), F.shiftright("block_at", 40)
    here = _inside(placed, _end(placed, coarse), coarse)
    here = _inside(here, written(_end(here, fine), "mixing-range"), fine)
    last = written(_end(here, F.col("block_at")), "mixing-block")
    docs = _inside(placed, last, F.col("block_at"))
    at_doc = F.sum("n").over(Window.partitionBy("source").orderBy("doc_at"))
    within = docs.withColumn("end", at_doc).groupBy(F.col("source").alias("s2")).agg(
        F.max(F.when(F.col("end") <= F.col("rest"), F.col("doc_at"))).alias("last_doc"))
    found = last.join(within, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.col("at").alias("last_block"), "last_doc")
    return written(plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mixing-plan")


def mix(docs: DataFrame, budget: float | None = None, max_epochs: float | None = MAX_EPOCHS,
        target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", token_col: str | None = None, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix draws them, with their places: ``copy`` (from 0), ``block``, ``block_at``, ``doc_at``."""
    session_for_text(docs.sparkSession, ROWS)
    columns = [c for c in docs.columns if c not in PLACES]
    source = F.col(source_col).cast("string")
    number = F.coalesce(F.col(token_col), F.lit(0)).cast("long") if token_col else F.lit(0).cast("long")
    key = F.xxhash64(F.col(id_col).cast("long"), *hashes(text_col), number)
    keyed = docs.select(key.alias("_key"), source.alias("_source"), F.col(text_col).alias("_text"), number.alias("_tokens"))
    keyed = keyed.drop("_text") if token_col else with_tokens(keyed, path)
    plan = mixing_plan(written(keyed, "mixing-tokens"), budget, max_epochs, target_entropy, block_tokens) \
        .select(F.struct("*").alias("_plan"))
    joined = docs.select(*columns, key.alias("_key")).join(F.broadcast(plan), source.eqNullSafe(F.col("_plan.source")))   # a row a source
    block = F.pmod(F.xxhash64("_key", F.lit(SEED)), F.col("_plan.blocks"))
    block_at = _order(F.col("_plan.epochs"), "block", "block")
    doc_at = _order(F.col("_plan.epochs"), "doc", "_key")
    last, last_doc, rest = F.col("_plan.last_block"), F.col("_plan.last_doc"), F.col("_plan.rest")
    once_more = (rest > 0) & (last.isNull() | (block_at < last) | ((block_at == last) & F.coalesce(doc_at <= last_doc, F.lit(False))))
    copies = F.col("_plan.epochs") + F.when(once_more, 1).otherwise(0)
    return joined.withColumn("block", block).withColumn("_copies", copies) \
        .where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))) \
        .withColumn("block_at", _order(F.col("copy"), "block", "block")).withColumn("doc_at", _order(F.col("copy"), "doc", "_key")) \
        .select(*columns, *PLACES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte BPE tokens: every one at least once, no source more than one and a half times."""
    return mix(table(spark, sf_dir, "documents"), path=default_path("byte_bpe_50k.json")).select("doc_id", "source", *PLACES)


def realise_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix draws them, by the tokens that the packing will count."""
    return mix(docs, path=default_path("byte_bpe_50k.json")).select(docs.columns)
