"""Token files: frequency-ranked ids in byte-aligned codes with separate control bytes.

Format (Parquet, so that Spark's writer commits each file once and any Hadoop
file system will do), one row a block of about ``BLOCK_TOKENS`` tokens:

* ``shard``, ``block``: order of the file parts; documents run in ascending id
  (null ids first) through the blocks of a shard and through the shards;
* ``first``: number of ids before the block in its shard, ``n_tokens`` in it;
* ``doc_ids``, ``lengths``: its documents and their numbers of ids;
* ``control``: two bits a value, four values a byte, low bits first: its bytes less one;
* ``data``: the values, one to four bytes each, little-endian.

A value is the rank of the id by frequency in the corpus (ties: smaller id first),
so the 256 most frequent ids take one byte. The second table, ``ranks``, has
``(rank, id, n)``. Decoding looks lengths up in a table by control byte and
gathers all values at once.

Defined results: a null text is empty and holds only the end id; repeated rows are
written each, those of one id in the order of a hash of their ids; a text
longer than a block is a block of its own; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.batch_tokens import ROWS, batch_encoder
from lexalign.llm.common import arrow_rows, per_batch, session_for_text, shuffle_width, table, utf8, written
from lexalign.llm.tokens import default_path

BLOCK_TOKENS = 1 << 20

#: By control byte: the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[:len(v)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode_values`."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    start = np.cumsum(size, dtype=np.int64) - size
    out = raw[start].astype("<u4")
    for extra in (1, 2, 3):
        more = np.flatnonzero(size > extra)
        if not len(more):
            break
        out[more] |= raw[start[more] + extra].astype("<u4") << np.uint32(8 * extra)
    return out


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every text and the end id, as little-endian bytes of the width the vocabulary needs."""
    width = "<u2" if batch_encoder(path).one.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype=width).tobytes()

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [ids + end for ids in batch_encoder(path).encode(utf8(batch.column(1)), width)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col) \
        .mapInArrow(per_batch(tokens), "doc_id long, ids binary").withColumn("width", F.lit(int(width[2])))


def rank_ids(tokens: DataFrame) -> DataFrame:
    """``(rank, id, n)`` of all ids in use: one row each, so no more than the vocabulary has."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, dtype=np.int64)
        for batch in batches:
            width = batch.column(1)[0].as_py() if batch.num_rows else 2
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"<u{width}")
            here = np.bincount(ids)
            if len(here) > len(n):
                n = np.pad(n, (0, len(here) - len(n)))
            n[:len(here)] += here
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["id", "n"])

    spark = tokens.sparkSession
    used = tokens.select("ids", "width").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(used.collect(), key=lambda r: (-r["n"], r["id"]))
    return spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(rows)], "rank long, id long, n long")


BLOCK_SCHEMA = ("shard int, block int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, "
                "control binary, data binary")


def write_token_files(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Write the files of all documents; the tables ``blocks`` and ``ranks`` as read from them."""
    spark = docs.sparkSession
    session_for_text(spark, ROWS)
    tokens = written(token_table(docs, path, end_id), "token-ids")
    ranks = written(rank_ids(tokens).coalesce(1), "token-ranks")
    pairs = np.array([(r["id"], r["rank"]) for r in ranks.collect()], dtype=np.int64).reshape(-1, 2)
    rank_of = np.zeros(int(pairs[:, 0].max(initial=0)) + 1, dtype="<u4")
    rank_of[pairs[:, 0]] = pairs[:, 1]
    held = spark.sparkContext.broadcast(rank_of)      # bounded by the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, held_tokens, parts = [], [], 0, []
        first, block, shard = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, held_tokens, parts, first, block
            values = held.value[np.concatenate(parts)]
            control, data = encode_values(values)
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                pa.array([held_tokens], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([control], pa.binary()),
                pa.array([data], pa.binary())],
                names=["shard", "block", "first", "n_tokens", "doc_ids", "lengths", "control", "data"])
            first, block = first + held_tokens, block + 1
            ids, lengths, held_tokens, parts = [], [], 0, []
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(3)[0].as_py()
            for doc_id, raw, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = np.frombuffer(raw, dtype=f"<u{width}")
                if held_tokens and held_tokens + len(values) > BLOCK_TOKENS:
                    yield flush()
                ids.append(doc_id)
                lengths.append(len(values))
                parts.append(values)
                held_tokens += len(values)
        if ids:
            yield flush()

    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shuffle_width(spark), "doc_id", "tie") \
        .sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids", "width", F.spark_partition_id().alias("shard"))
    return written(ordered.mapInArrow(blocks, BLOCK_SCHEMA), "token-files"), ranks


def read_token_files(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; ``ids`` are little-endian unsigned 32-bit."""
    return _read(blocks, ranks, keep_ids=True)


def _read(blocks: DataFrame, ranks: DataFrame, keep_ids: bool) -> DataFrame:
    spark = blocks.sparkSession
    id_rows = ranks.orderBy("rank").collect()         # bounded by the vocabulary
    ids_by_rank = spark.sparkContext.broadcast(np.array([r["id"] for r in id_rows], dtype="<u4"))
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()   # a row a shard
    before, offsets = 0, []
    for r in sums:
        offsets.append((r["shard"], before))
        before += r["n"]
    at = spark.createDataFrame(offsets, "shard int, offset long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = ids_by_rank.value[decode_values(row["control"], row["data"], row["n_tokens"])]
                n = np.array(row["lengths"], dtype=np.int64)
                end = np.cumsum(n)
                raw = values.tobytes()
                parts = [raw[4 * (e - k):4 * e] for e, k in zip(end.tolist(), n.tolist())]
                last = pa.array(parts, pa.binary()) if keep_ids else \
                    pa.array([zlib.crc32(p) for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(end - n + row["first"] + row["offset"]),
                    pa.array(n), last], names=["doc_id", "start", "n_tokens", "ids" if keep_ids else "ids_crc32"])

    return blocks.join(F.broadcast(at), "shard").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, " + ("ids binary" if keep_ids else "ids_crc32 long"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, word BPE, end id 1: written, read back and digested."""
    files = write_token_files(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), 1)
    with arrow_rows(spark, 8):
        return written(_read(*files, keep_ids=False), "token-digests")
