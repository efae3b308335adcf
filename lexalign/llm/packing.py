"""Best-fit packing with certified bin counts and exchange between partitions.

Texts become token ids and an end id; those over ``size`` are cut into pieces of
``size`` ids, the first of which may be shorter. A piece of ``size`` ids is a
sequence by itself. The others are dealt into partitions of about ``PART_ROWS`` by a
hash, and each partition is packed by best-fit decreasing. Dual feasible functions
give a lower bound of the bins that any packing of the partition needs; where it
equals the bins used, the partition is certified as optimal. The partitions with a
gap give up the pieces of their bins that are not full; these are dealt anew, into half
as many partitions, and best-fit decreasing runs again. The new bins replace the old
ones if they are fewer. Partitions grow to ``PART_ROWS * 2 ** DOUBLINGS`` pieces; from then on deals go on at that size as
long as they save bins, and end after ``PATIENCE`` that do not, or when no partition has a gap or there is one left.

The certificate has a row for every partition that stands in the end: its bins, its bound, and whether they are equal.
Bins that are full need no partner, so those of partitions that gave up the others are rows of their own.

Every round is one shuffle of ``(uid, length)`` rows; texts and ids are not moved.
A partition's size does not depend on the data, so no task grows with the input.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows are packed each, with equal ``doc_id`` and ``piece``; a null id is kept;
ties of length are ordered by the row's number; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.batch_tokens import ROWS, batch_encoder
from lexalign.llm.common import free_memory, session_for_text, table, utf8, written
from lexalign.llm.tokens import default_path

SIZE = 2048
PART_ROWS = 1 << 16
DOUBLINGS = 3
PATIENCE = 2

PIECES_SCHEMA = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int, size: int = SIZE, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all texts; ``uid`` numbers them, ``ids`` (if kept) are little-endian unsigned 32-bit."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        free_memory()
        enc = batch_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(utf8(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or min(n, size), n + 1, size)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    rows.append((uid, doc_id, i, a, b - a, zlib.crc32(part), *([part] if keep_ids else [])))
                    uid += 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[:len(rows[0])])
        enc.forget()
        free_memory()

    schema = PIECES_SCHEMA + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions."""
    n = np.bincount(lengths, minlength=size + 1)[:size + 1].astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int(n @ x) // size)
    count, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    for low in range(1, size // 2 + 1):           # over size - low counts as a bin, under low as nothing
        large = int(count[-1] - count[size - low + 1])
        middle = int(volume[size - low + 1] - volume[low])
        best = max(best, large - (-middle // size))
    for k in range(1, 101):                       # steps of 1 / k; multiples of 1 / (k + 1) stay as they are
        scaled = x * (k + 1)
        whole = scaled % size == 0
        value = np.where(whole, x * k, scaled // size * size)      # in units of 1 / (k * size)
        best = max(best, -(-int(n @ value) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]         # bins by what is free in them
    free, used = 0, 0                                            # bit r: a bin with r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = free >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, at, used = size, used, used + 1
        bins[i], offsets[i] = at, size - left
        left -= need
        if left:
            room[left].append(at)
            free |= 1 << left
    return bins, offsets, used


PACKED_SCHEMA = "uid long, length int, part long, bin long, offset int, fill int, bins long, bound long"


def _pack_part(key: tuple, rows: pa.Table) -> pa.Table:
    uid = rows.column("uid").to_numpy()
    order = np.argsort(uid, kind="stable")
    uid, lengths = uid[order], rows.column("length").to_numpy()[order].astype(np.int64)
    bins, offsets, used = best_fit_decreasing(lengths)
    fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
    n = len(uid)
    return pa.table({
        "uid": uid, "length": pa.array(lengths, pa.int32()), "part": pa.array([key[0].as_py()] * n, pa.int64()),
        "bin": bins, "offset": pa.array(offsets, pa.int32()), "fill": pa.array(fill[bins], pa.int32()),
        "bins": pa.array([used] * n, pa.int64()), "bound": pa.array([lower_bound(lengths)] * n, pa.int64())})


def _bins(packed: DataFrame) -> DataFrame:
    """One row a partition: its bins and its lower bound."""
    return packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))


CERTIFICATE_SCHEMA = "turn int, kind string, part long, bins long, bound long"


def pack(short: DataFrame, part_rows: int = PART_ROWS, doublings: int = DOUBLINGS,
         patience: int = PATIENCE) -> tuple[DataFrame, DataFrame]:
    """``(uid, sequence, offset)`` for the items ``(uid, length)``, and the certificate ``(turn, kind, part, bins, bound)``."""
    def run(items: DataFrame, n: int, turn: int) -> DataFrame:
        parts = max(1, -(-n // (part_rows << min(turn, doublings))))
        dealt = items.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        return written(dealt.groupBy("part").applyInArrow(_pack_part, PACKED_SCHEMA), "packed")

    def placed(packed: DataFrame, level: int) -> DataFrame:
        sequence = F.col("part") * (1 << 24) + F.col("bin") + (level << 56)
        return packed.select("uid", sequence.alias("sequence"), "offset")

    def report(rows: DataFrame, level: int, kind: str) -> DataFrame:
        return rows.select(F.lit(level).alias("turn"), F.lit(kind).alias("kind"), "part", "bins", "bound")

    now = run(short.select("uid", "length"), short.count(), 0)
    done, certificate = [], []
    turn, level, misses = 0, 0, 0
    while True:
        found = written(_bins(now), "bins")
        open_parts = found.where("bins > bound").select("part")
        sums = found.agg(F.count("*").alias("parts"), F.count_if(F.col("bins") > F.col("bound")).alias("gaps")).first()
        if not sums["gaps"] or sums["parts"] == 1 or level == 127:
            break
        given = now.join(F.broadcast(open_parts), "part", "left_semi")         # bounded: a row a partition
        pool = written(given.where(F.col("fill") < SIZE), "exchanged")
        before, n = pool.select("part", "bin").distinct().count(), pool.count()
        again, after = None, before
        while n and after >= before and misses < patience:                     # other deals until one saves bins
            turn += 1
            again = run(pool.select("uid", "length"), n, turn)
            after = _bins(again).agg(F.sum("bins")).first()[0]
            misses = 0 if after < before else misses + (turn >= doublings)
        if after >= before:
            break
        stays = found.where("bins = bound")
        full = given.where(F.col("fill") == SIZE).groupBy("part").agg(F.count_distinct("bin").alias("bins")).withColumn("bound", F.col("bins"))
        certificate += [report(stays, level, "partition"), report(full, level, "full bins")]
        done.append(placed(now.join(pool.select("uid"), "uid", "left_anti"), level))
        now, level = again, level + 1
    out, rows = placed(now, level), report(found, level, "partition")
    for part in done:
        out = out.unionAll(part)
    for part in certificate:
        rows = rows.unionAll(part)
    return out, rows


def pack_with_certificate(docs: DataFrame, path: str, end_id: int, part_rows: int = PART_ROWS, doublings: int = DOUBLINGS,
                          patience: int = PATIENCE) -> tuple[DataFrame, DataFrame]:
    """Every piece of ``docs`` with its sequence and its place there, and the certificate of all sequences."""
    session_for_text(docs.sparkSession, ROWS)
    found = written(pieces(docs, path, end_id), "pieces")
    whole = found.where(F.col("length") == SIZE).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0))
    short = found.where(F.col("length") < SIZE)
    places, certificate = pack(short, part_rows, doublings, patience)
    placed = short.join(places, "uid").withColumnRenamed("sequence", "sequence_id")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = whole.select(columns).unionAll(placed.select(columns)).withColumn("length", F.col("length").cast("long")) \
        .withColumn("offset", F.col("offset").cast("long"))
    filled = whole.agg(F.lit(0).alias("turn"), F.lit("whole pieces").alias("kind"), F.lit(None).cast("long").alias("part"),
                       F.count("*").alias("bins"), F.count("*").alias("bound"))
    return packed, certificate.unionAll(filled).withColumn("certified", F.col("bins") == F.col("bound"))


def pack_documents(docs: DataFrame, path: str, end_id: int, certificate_path: str | None = None, **options) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its place there; the certificate is written if it has a path."""
    packed, certificate = pack_with_certificate(docs, path, end_id, **options)
    if certificate_path:
        certificate.write.parquet(certificate_path)
    return packed


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte BPE, end id 0, sequences of 2048."""
    return pack_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), 0)
