"""Repeated passages by prefix-free parsing.

Every string of ``LENGTH`` bytes that also starts in a document with a smaller id is
to go. The parse cuts each text into phrases that overlap by ``LENGTH - 1`` bytes,
so that every string of that length lies in exactly one phrase. A trigger is the
position whose rolling hash (of ``GRAM`` bytes) is the least of a string's; all
strings with the same trigger position make up a phrase. The trigger depends on the
string alone, so equal strings lie in phrases with equal triggers, wherever they are.

Four passes over the texts, each a map over chunks of documents that asks questions
and, from the second on, has the answers of those before:

1. triggers: is the trigger known elsewhere? If not, no string of the phrase repeats.
2. dictionary: is the phrase in a document with a smaller id? Then all its strings
   repeat. Are there several phrases for its trigger? If not, the phrase that the
   smallest document has, shares no string with another.
3. suffixes: what is left, phrases of one trigger that differ, are compared by
   their suffixes of ``LENGTH`` bytes and more: those of all dictionary phrases are sorted, and
   runs that agree in the first ``LENGTH`` bytes are joined with the smallest document that the
   parse has for their phrases. The order is made in buckets of suffixes.
4. what was found is cut out.

Questions are about distinct triggers, phrases or suffixes of a chunk with the
chunk's smallest document for each (a map-side combine), packed in one binary row for
each chunk and bucket; an answer is one bit a question. So a passage that a third of
all documents share is in a group of one entry a chunk. The chunks are a table bucketed by
chunk, compressed once: joining the answers to them moves no text.

Phrases are compared by two 64-bit hashes with different multipliers, suffixes byte by byte.

Defined results: a null text is empty, and so is what is kept of it; texts under
``LENGTH`` bytes stay whole; matches never cross documents; a null id counts as larger
than every other; rows of one id do not cover each other, so repeated rows stay or
go alike; an empty table gives an empty result; other columns are not touched. A span may
cut a UTF-8 character: ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.common import arrow_rows, drop_worker_cache, free_memory, seed64, session_for_text, shuffle_width, table, utf8, written
from lexalign.session import scratch_path

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 1 << 22
#: Strings of one step of numpy work.
STEP = 1 << 20
POSITION = np.uint64((1 << 21) - 1)
#: Text bytes for each bucket of questions.
BUCKET_BYTES = 1 << 25
NO_ID = np.iinfo(np.int64).max

TRIGGER, SEVERAL, PHRASE, SUFFIX = range(4)
MULTIPLIER, SECOND = (np.uint64(seed64(name) | 1) for name in ("rolling hash", "second hash"))


@lru_cache(maxsize=2)
def _powers(multiplier: np.uint64 = MULTIPLIER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number for each byte, and the powers of a multiplier and of its inverse."""
    n = STEP + LENGTH + 1
    name = "bytes" if multiplier == MULTIPLIER else f"bytes of {multiplier}"
    byte = np.random.default_rng(seed64(name)).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = np.uint64(pow(int(multiplier), -1, 1 << 64))
    power = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)], dtype=np.uint64) for x in (multiplier, inverse)]
    return byte, power[0], power[1]


def _spread(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Parse:
    """The phrases of a chunk: trigger and phrase hashes, first and last string, document."""

    def __init__(self, text: bytes, ends: np.ndarray, ids: np.ndarray):
        self.text = np.frombuffer(text, dtype=np.uint8)
        self.ends, self.ids = ends, ids
        self.starts = np.r_[0, ends[:-1]]
        whole = np.zeros(len(self.text), dtype=bool)             # a string starts here and ends in its document
        for a, b in zip(self.starts.tolist(), ends.tolist()):
            if b - a >= LENGTH:
                whole[a:b - LENGTH + 1] = True
        parts = [self._step(a, whole) for a in range(0, max(0, len(self.text) - LENGTH + 1), STEP)]
        self.trigger, self.phrase, self.first, self.last = (
            np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=t)
            for i, t in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
        self.doc = ids[np.searchsorted(ends, self.first, side="right")]

    def second(self, chosen: np.ndarray) -> np.ndarray:
        """Another hash of the bytes of chosen phrases, of other numbers and powers."""
        out = np.zeros(len(chosen), dtype=np.uint64)
        byte, power, inverse = _powers(SECOND)
        first, end = self.first[chosen], self.last[chosen] + LENGTH
        for at in range(0, max(0, len(self.text) - LENGTH + 1), STEP):
            mine = np.flatnonzero((first >= at) & (first < at + STEP))        # a phrase ends within LENGTH - 1 bytes of its step
            text = self.text[at:at + STEP + LENGTH - 1]
            prefix = np.zeros(len(text) + 1, dtype=np.uint64)
            np.cumsum(byte[text] * power[:len(text)], out=prefix[1:])
            out[mine] = _spread((prefix[end[mine] - at] - prefix[first[mine] - at]) * inverse[first[mine] - at])
        return out

    def _step(self, at: int, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        byte, power, inverse = _powers()
        text = self.text[at:at + STEP + LENGTH - 1]
        n = len(text)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte[text] * power[:n], out=prefix[1:])
        gram = _spread((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:n - GRAM + 1])
        least = (gram & ~POSITION) | np.arange(len(gram), dtype=np.uint64)
        span, size = LENGTH - GRAM + 1, 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < span:
            least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
        here = np.flatnonzero(whole[at:at + len(least)])
        if not len(here):
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        spot = (least[here] & POSITION).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (np.diff(spot) != 0) | (np.diff(here) != 1)])
        first, last, spot = here[new], here[np.r_[new[1:], len(here)] - 1], spot[new]
        phrase = (prefix[last + LENGTH] - prefix[first]) * inverse[first] \
            + (spot - first + 64 * (last - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return gram[spot], _spread(phrase), first + at, last + at

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, documents and the first ``LENGTH`` bytes of the suffixes of the chosen phrases."""
        n = (self.last - self.first + 1)[chosen]
        start = np.repeat(self.first[chosen] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return start, np.repeat(self.doc[chosen], n), \
            np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.text, LENGTH)[start]) if len(start) \
            else np.zeros((0, LENGTH), dtype=np.uint8)


class Questions:
    """Distinct keys of a chunk in the order of their buckets, the smallest document of each."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: int, more: np.ndarray | None = None):
        if more is None:
            self.keys, self.row, self.of = np.unique(keys, return_index=True, return_inverse=True)
        else:           # keys of 128 bits
            order = np.lexsort((more, keys))
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
            self.row, self.of = order[new], np.empty(len(keys), dtype=np.int64)
            self.of[order] = np.cumsum(new) - 1
            self.keys, self.more = keys[self.row], more[self.row]
        self.low = np.full(len(self.keys), NO_ID)
        np.minimum.at(self.low, self.of, docs)
        bucket = (self.keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.at = np.unique(bucket[self.order], return_index=True)
        self.end = np.r_[self.at[1:], len(self.order)]

    def rows(self, kind: int, pack) -> Iterator[tuple[int, int, int, bytes]]:
        """``(kind, bucket, n, data)``; ``pack`` makes the data of some keys by their indexes."""
        for bucket, a, b in zip(self.bucket.tolist(), self.at.tolist(), self.end.tolist()):
            yield kind, bucket, b - a, pack(self.order[a:b])

    def answers(self, found: dict[int, bytes]) -> np.ndarray:
        """One bit for each key."""
        out = np.zeros(len(self.keys), dtype=bool)
        for bucket, a, b in zip(self.bucket.tolist(), self.at.tolist(), self.end.tolist()):
            if bucket in found:
                out[self.order[a:b]] = np.unpackbits(np.frombuffer(found[bucket], dtype=np.uint8))[:b - a]
        return out


def _short(keys: np.ndarray, width: int) -> bytes:
    """The upper bytes of 64-bit keys (the lower ones choose the bucket)."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 8 - width:] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(n, width)
    return out.view(">u8").ravel().astype(np.uint64)


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


class Chunk:
    """A chunk's parse and, as far as there are answers, what of it repeats."""

    def __init__(self, row: dict, buckets: int, answers: dict[int, dict[int, bytes]]):
        self.row, self.buckets = row, buckets
        ids = np.array([NO_ID if x is None else x for x in row["doc_ids"]], dtype=np.int64)
        self.p = p = Parse(_UNPACK.decompress(row["data"]), np.cumsum(np.array(row["lengths"], dtype=np.int64)), ids)
        self.triggers = t = Questions(p.trigger, p.doc, buckets)
        if TRIGGER not in answers:
            return
        live = t.answers(answers[TRIGGER]) | (np.bincount(t.of, minlength=len(t.keys)) > 1)
        self.live = live = np.flatnonzero(live[t.of])
        self.several = Questions(p.trigger[live], p.doc[live], buckets)
        self.phrases = Questions(p.phrase[live], p.doc[live], buckets, p.second(live))
        # the phrase of a trigger, or 0 for several
        some = p.phrase[live][self.several.row]
        mixed = np.zeros(len(some), dtype=bool)
        np.logical_or.at(mixed, self.several.of, p.phrase[live] != some[self.several.of])
        self.one_phrase = np.where(mixed, 0, some | np.uint64(1 << 16))
        if PHRASE not in answers:
            return
        q = self.phrases
        self.covered = q.answers(answers[PHRASE])[q.of] | (p.doc[live] > q.low[q.of])
        several = (self.several.answers(answers[SEVERAL]) | mixed)[self.several.of]
        self.start, self.start_doc, self.bytes = p.suffixes(live[several & ~self.covered])
        hashed = np.zeros(len(self.start), dtype=np.uint64)
        for i in [*range(0, LENGTH - 7, 8), LENGTH - 8]:          # eight bytes at a time
            eight = np.ascontiguousarray(self.bytes[:, i:i + 8]).view("<u8").reshape(len(hashed))
            hashed = _spread(hashed * MULTIPLIER + eight)
        self.suffixes = Questions(hashed, self.start_doc, buckets)
        self.found = answers.get(SUFFIX)

    def ask_triggers(self) -> Iterator[tuple]:
        q = self.triggers
        yield from q.rows(TRIGGER, lambda i: _short(q.keys[i], 5))

    def ask_dictionary(self) -> Iterator[tuple]:
        s, q = self.several, self.phrases
        yield from s.rows(SEVERAL, lambda i: _short(s.keys[i], 5) + _short(self.one_phrase[i], 6))
        yield from q.rows(PHRASE, lambda i: np.stack([q.keys[i], q.more[i]], axis=1).astype("<u8").tobytes()
                          + _PACK.compress(q.low[i].astype("<i8").tobytes()))

    def ask_suffixes(self) -> Iterator[tuple]:
        q = self.suffixes

        def pack(i: np.ndarray) -> bytes:
            strings = _PACK.compress(self.bytes[q.row[i]].tobytes())
            return len(strings).to_bytes(4, "little") + strings + _PACK.compress(q.low[i].astype("<i8").tobytes())
        yield from q.rows(SUFFIX, pack)

    def removed(self) -> np.ndarray:
        """Mask of the bytes that go."""
        p, q = self.p, self.suffixes
        repeats = np.zeros(len(p.text) + 1, dtype=np.int32)
        first, last = p.first[self.live[self.covered]], p.last[self.live[self.covered]]
        np.add.at(repeats, first, 1)
        np.add.at(repeats, last + 1, -1)
        repeats = np.cumsum(repeats)[:-1] > 0
        repeats[self.start[q.answers(self.found)[q.of] | (self.start_doc > q.low[q.of])]] = True
        so_far = np.cumsum(repeats, dtype=np.int64)
        so_far[LENGTH:] -= so_far[:-LENGTH].copy()
        return so_far > 0


ASKED = "kind int, bucket int, chunk long, n int, data binary"
ANSWERED = "chunk long, kind int, bucket int, bits binary"


def answer(key: tuple, rows: pa.Table) -> pa.Table:
    """The bits of all questions of one kind and bucket."""
    kind = key[0].as_py()
    n = rows.column("n").to_numpy().astype(np.int64)
    data = rows.column("data").to_pylist()
    if kind == TRIGGER:
        keys = np.concatenate([_long(d, k, 5) for d, k in zip(data, n)])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        yes = np.r_[False, same] | np.r_[same, False]
    elif kind == SEVERAL:
        keys = np.concatenate([_long(d, k, 5) for d, k in zip(data, n)])
        one = np.concatenate([_long(d[5 * k:], k, 6) for d, k in zip(data, n.tolist())])
        order = np.lexsort((one, keys))
        run = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        size = np.diff(np.r_[run, len(keys)])
        low, high = one[order][run], one[order][run + size - 1]
        yes = np.repeat((low != high) | (low == 0), size)
    else:
        if kind == PHRASE:
            keys = np.concatenate([np.frombuffer(d, dtype="S16", count=k) for d, k in zip(data, n)])
            docs = [d[16 * k:] for d, k in zip(data, n.tolist())]
        else:
            cut = [int.from_bytes(d[:4], "little") for d in data]
            keys = np.frombuffer(b"".join(_UNPACK.decompress(d[4:4 + c]) for d, c in zip(data, cut)), dtype=f"S{LENGTH}")
            docs = [d[4 + c:] for d, c in zip(data, cut)]
        doc = np.frombuffer(b"".join(map(_UNPACK.decompress, docs)), dtype="<i8")
        order = np.argsort(keys, kind="stable")
        run = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        size = np.diff(np.r_[run, len(keys)])
        yes = doc[order] > np.repeat(np.minimum.reduceat(doc[order], run), size)
    bits = np.empty(len(order), dtype=bool)
    bits[order] = yes
    end = np.cumsum(n)
    return pa.table({"chunk": rows.column("chunk"), "kind": pa.array([kind] * len(n), pa.int32()),
                     "bucket": pa.array([key[1].as_py()] * len(n), pa.int32()),
                     "bits": pa.array([np.packbits(bits[e - k:e]).tobytes() for e, k in zip(end, n)], pa.binary())})


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Documents packed into rows of about ``chunk_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, texts, held
            row = pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([held], pa.int64()),
                pa.array([pack.compress(b"".join(texts))], pa.binary())],
                names=["chunk", "doc_ids", "lengths", "n_bytes", "data"])
            number, ids, texts, held = number + 1, [], [], 0
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if ids and held + len(text) > chunk_bytes:
                    yield flush()
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "chunk long, doc_ids array<long>, lengths array<long>, n_bytes long, data binary")


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return [{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES, with_md5: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every row: the removed spans in bytes, and what is left.

    On request with ``md5`` of the text of rows that have spans.
    """
    spark = docs.sparkSession
    session_for_text(spark)
    name = f"chunks_{uuid.uuid4().hex[:12]}"
    width = min(shuffle_width(spark), 10_000)
    chunked(docs, id_col, text_col, chunk_bytes).write.bucketBy(width, "chunk") \
        .option("path", scratch_path(spark, name)).option("compression", "none").saveAsTable(name)
    chunks = spark.table(name)
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(width, -(-n_bytes // BUCKET_BYTES))
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()),
                        ("data", pa.binary())])

    def asked(rows: Iterator[tuple], chunk: int) -> pa.Table:
        cols = list(zip(*((k, b, chunk, n, d) for k, b, n, d in rows))) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    def freed(out: pa.Table) -> pa.Table:
        """The result, after what its chunk's steps have freed went back to the system."""
        free_memory()
        return out

    def loaded(chunk: pa.Table, found: pa.Table | None = None, kinds: int = 0) -> Chunk:
        """The chunk with the answers of ``kinds`` kinds, also where it asked nothing."""
        drop_worker_cache()
        answers: dict[int, dict[int, bytes]] = {kind: {} for kind in range(kinds)}
        if found is not None:
            for kind, bucket, bits in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "bits"))):
                answers[kind][bucket] = bits
        return Chunk(chunk.to_pylist()[0], buckets, answers)

    def ask_triggers(chunk: pa.Table) -> pa.Table:
        c = loaded(chunk)
        return freed(asked(c.ask_triggers(), c.row["chunk"]))

    def ask_dictionary(chunk: pa.Table, found: pa.Table) -> pa.Table:
        c = loaded(chunk, found, SEVERAL)
        return freed(asked(c.ask_dictionary(), c.row["chunk"]))

    def ask_suffixes(chunk: pa.Table, found: pa.Table) -> pa.Table:
        c = loaded(chunk, found, SUFFIX)
        return freed(asked(c.ask_suffixes(), c.row["chunk"]))

    def cut(chunk: pa.Table, found: pa.Table) -> pa.Table:
        c = loaded(chunk, found, SUFFIX + 1)
        gone, text = c.removed(), c.p.text
        ranges = list(zip(c.p.starts.tolist(), c.p.ends.tolist()))
        md5 = {"md5": pa.array([hashlib.md5(text[a:b].tobytes()).hexdigest() if gone[a:b].any() else None
                                for a, b in ranges], pa.string())} if with_md5 else {}
        return pa.table({
            "doc_id": pa.array(c.row["doc_ids"], pa.int64()), "n_bytes": pa.array(c.row["lengths"], pa.int64()),
            "spans": pa.array([_spans(gone[a:b]) for a, b in ranges],
                              pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
            "kept": pa.array([text[a:b][~gone[a:b]].tobytes() for a, b in ranges], pa.binary())} | md5)

    def answered(questions: DataFrame, step: str) -> DataFrame:
        return written(questions.groupBy("kind", "bucket").applyInArrow(answer, ANSWERED), step)

    def with_answers(found: DataFrame, run, out: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, out)

    with arrow_rows(spark, 256):
        found = answered(chunks.groupBy("chunk").applyInArrow(ask_triggers, ASKED), "triggers")
        more = answered(with_answers(found, ask_dictionary, ASKED), "dictionary")
        found = found.unionAll(more)
        found = found.unionAll(answered(with_answers(found, ask_suffixes, ASKED), "suffixes"))
    out = with_answers(found, cut, KEPT + ", md5 string" if with_md5 else KEPT)
    spark.sql(f"DROP TABLE {name}")          # the name goes; the files stay in the shared folder until the result is read
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 50 bytes."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages; of a cut character the rest goes too.

    What is cut depends on the id and the text, so both tell which rows a result is for.
    """
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.decode("utf-8", "ignore") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                pa.array([None if t is None else len(t) for t in texts], pa.int64())], names=["_id", "_md5", "_text", "_n"])

    kept = remove_repeats(docs, with_md5=True).where("size(spans) > 0").select("doc_id", "md5", "kept") \
        .mapInArrow(decoded, "_id long, _md5 string, _text string, _n long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.col("text").cast("binary")) == F.col("_md5"))
    joined = docs.join(kept.dropDuplicates(["_id", "_md5"]), same, "left")
    changed = F.col("_text").isNotNull()
    return joined.withColumn("text", F.when(changed, F.col("_text")).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(changed, F.col("_n")).otherwise(F.col("n_chars"))).select(docs.columns)
