"""Token counts by a map-side lookup of two tiers.

Tier one is a compact table ``piece -> number of tokens`` of frequent pieces,
broadcast to every worker. It is found from all texts: each task keeps bounded
frequency summaries and reports the pieces that make up ``1 / TABLE_PIECES`` of
its own pieces or more. Any piece with that share of the corpus has it in some task,
so the sums over the reports find all of them, and there can be no more than
``TABLE_PIECES`` of them, of ``PIECE_BYTES`` at most: a few MB at any size of the
corpus. Tier two is the worker's bounded cache, which encodes what it misses. No
pre-token is ever shuffled, only the task summaries.

The table is only a cache: counts do not depend on it.

Defined results: a null text is empty and has no tokens; special strings inside
texts are what the library makes of them; repeated rows and null ids give one row
each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.common import per_batch, session_for_text, table, utf8
from lexalign.llm.tokens import default_path, encoder

TABLE_PIECES = 1 << 15
PIECE_BYTES = 64
#: Pieces that a task's summary holds at once.
SUMMARY_PIECES = 1 << 18
MAX_TOKENS = 2048


class Summary:
    """Frequent items of a stream in bounded memory: each count is short by ``lost`` at most."""

    def __init__(self, size: int = SUMMARY_PIECES):
        self.counts, self.size, self.total, self.lost = Counter(), size, 0, 0

    def add(self, items: list[str]) -> None:
        self.counts.update(items)
        self.total += len(items)
        if len(self.counts) > self.size:
            cut = nlargest(self.size // 2, self.counts.values())[-1]
            self.lost += cut
            self.counts = Counter({k: v - cut for k, v in self.counts.items() if v > cut})

    def frequent(self, share: float) -> list[tuple[str, int]]:
        return [(k, v) for k, v in self.counts.items() if v + self.lost >= share * self.total]


def frequent_pieces(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of the pieces that make up ``1 / TABLE_PIECES`` of all pieces or more."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, enc = Summary(), encoder(path)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.add(enc.cut(text or ""))
        rows = [(k, v, len(enc.piece_ids(k)) // 4) for k, v in seen.frequent(1 / TABLE_PIECES)
                if len(k.encode()) <= PIECE_BYTES]
        rows.append((None, seen.total, 0))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32())], names=["piece", "n", "tokens"])

    sums = docs.select(text_col).mapInArrow(report, "piece string, n long, tokens int") \
        .groupBy("piece").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
    # the total comes first; no more than TABLE_PIECES pieces can have the share that is asked for
    total, *rows = sums.orderBy(F.col("piece").isNull().desc(), F.col("n").desc()).limit(TABLE_PIECES + 1).collect() \
        or [{"n": 0}]
    return {r["piece"]: r["tokens"] for r in rows if r["n"] * TABLE_PIECES >= total["n"]}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row."""
    spark = docs.sparkSession
    session_for_text(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    two_tiers = encoder(path).kind == "word"
    name = uuid.uuid4().hex
    frequent = spark.sparkContext.broadcast(frequent_pieces(docs, path, text_col) if two_tiers else {})

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        raw = utf8(batch.column(1))
        if two_tiers:
            length = enc.counter(name, frequent.value).__getitem__
            tokens = [sum(map(length, enc.cut(t.decode()))) for t in raw]
        else:
            tokens = [len(enc.ids(t.decode())) // 4 for t in raw]
        n = np.array(tokens, dtype=np.int64)
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(n), pa.array(n > max_tokens)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(
        per_batch(count), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, word BPE, limit 2048."""
    return count_tokens(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
