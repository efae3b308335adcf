"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, cut into ``SEGMENTS`` neighbouring segments that form
a ring. If two fingerprints differ in at most ``t`` bits, then for some start the
first ``l`` segments from it differ in at most ``l * t / SEGMENTS`` bits, for every
``l`` (the strong pigeonhole principle on a ring). While that budget is below one,
the segments must be equal: these first segments are the bucket key, one key for
each start. Inside a bucket a pair must pass the budget of every longer chain, and
the last chain is the whole ring, which is the full Hamming check.

Work is kept linear in the data:

* equal fingerprints are one node, so copies cost one row of a partial aggregate;
* a bucket gives the edges of a spanning forest, never all of its pairs;
* a bucket of over ``BUCKET_ROWS`` fingerprints is not compared in its task but
  cut again by the same principle on the bits that the key leaves free. What then
  shares both keys has at most 22 free bits, so its size is bounded; if it is
  still large, it is linked by sorting under every choice of masked bits.

Components come from alternating large-star and small-star rounds over written
edge tables; nothing but two counters reaches the driver.

Defined results: null and empty texts, and texts of white space, have fingerprint
zero and are linked like any other; texts of fewer words than a shingle are one
shingle; repeated rows give repeated rows; a row with a null id gets a component
like any other, but does not name one (the component of null ids alone is null);
an empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from lexalign.llm.common import arrow_rows, drop_worker_cache, hashes, per_batch, session_for_text, table, utf8, written

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
SEGMENTS = 7
SUB_SEGMENTS = 5
BUCKET_ROWS = 1024
#: Shingles whose bits are unpacked at once.
UNPACK_ROWS = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit integer."""
    words = text.lower().split()          # of bytes: only A-Z, only \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxh64_intdigest(b" ".join(words), HASH_SEED)], dtype="<u8")
    else:
        parts = zip(*(words[i:] for i in range(shingle)))
        hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(HASH_SEED)), dtype="<u8",
                             count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), UNPACK_ROWS):
        block = hashes[at:at + UNPACK_ROWS]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        drop_worker_cache()
        fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType
    kind = kind.simpleString() if isinstance(kind, StructType) else "long"
    return docs.select(F.col(id_col).cast(kind).alias("doc_id"), text_col).mapInArrow(per_batch(of), f"doc_id {kind}, fp long")


class Ring:
    """Segments of ``width`` bits at ``positions`` as a ring, with the budgets of its chains."""

    def __init__(self, width: int, segments: int, max_bits: int):
        cuts = [width * i // segments for i in range(segments + 1)]
        self.at = cuts[:-1]
        self.bits = [b - a for a, b in zip(cuts, cuts[1:])]
        self.segments, self.max_bits = segments, max_bits
        #: Segments from the start that must be equal.
        self.equal = segments if max_bits == 0 else min(segments, (segments - 1) // max_bits)

    def segment(self, x: np.ndarray, i: int) -> np.ndarray:
        i %= self.segments
        return (x >> np.uint64(self.at[i])) & np.uint64((1 << self.bits[i]) - 1)

    def key(self, x: np.ndarray, start: int) -> np.ndarray:
        """The equal segments from ``start``, with the start itself in the lowest bits."""
        key = np.zeros(len(x), dtype=np.uint64)
        for i in range(start, start + self.equal):
            key = (key << np.uint64(self.bits[i % self.segments])) | self.segment(x, i)
        return (key << np.uint64(4)) | np.uint64(start)

    def passes(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indexes of the pairs of which every chain from their start keeps its budget."""
        left = np.arange(len(a))
        x = a ^ b
        spent = np.zeros(len(a), dtype=np.int64)
        for length in range(1, self.segments + 1):
            i = (start[left] + np.uint64(length - 1)) % np.uint64(self.segments)
            at = np.array(self.at, dtype=np.uint64)[i.astype(np.int64)]
            width = np.array([(1 << b) - 1 for b in self.bits], dtype=np.uint64)[i.astype(np.int64)]
            spent = spent + np.bitwise_count((x[left] >> at) & width)
            ok = spent <= length * self.max_bits // self.segments
            left, spent = left[ok], spent[ok]
        return left


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges ``a - b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def link_buckets(bucket: np.ndarray, fp: np.ndarray, start: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside each run of equal ``bucket`` values."""
    n = len(fp)
    end = np.searchsorted(bucket, bucket, side="right") if n else bucket
    found_a, found_b, held = [], [], 0
    label = np.arange(n)
    here = np.flatnonzero(end > np.arange(n) + 1)
    lag = 1
    while len(here):
        there = here + lag
        ok = ring.passes(fp[here], fp[there], start[here])
        found_a.append(here[ok])
        found_b.append(there[ok])
        held += len(ok)
        if held > 4 * n + 100_000:
            label = forest(n, label[np.concatenate(found_a)], label[np.concatenate(found_b)])[label]
            found_a, found_b, held = [], [], 0
        lag += 1
        here = here[end[here] > here + lag]
    if held:
        label = forest(n, label[np.concatenate(found_a)], label[np.concatenate(found_b)])[label]
    joined = np.flatnonzero(label != np.arange(n))
    return fp[joined], fp[label[joined]]


def link_by_masks(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links of one large bucket: equal under some mask of ``max_bits`` free bits."""
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << i for i in range(64) if free >> i & 1]
    label = np.arange(len(fp))
    for masked in combinations(bits, min(max_bits, len(bits))):
        kept = fp & np.uint64(~sum(masked) & (1 << 64) - 1)
        order = np.argsort(kept, kind="stable")
        same = np.flatnonzero(kept[order[1:]] == kept[order[:-1]])
        label = forest(len(fp), label[order[same]], label[order[same + 1]])[label]
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows ``(key, sub, fp)`` cut at bucket ends; buckets over ``limit`` come in parts, flagged."""
    held: list[np.ndarray] | None = None
    large = False
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
        cols = new if held is None else [np.concatenate([h, c]) for h, c in zip(held, new)]
        key, sub = cols[0], cols[1]
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if large and cut:                                  # the large bucket ends inside these rows
            end = int(np.flatnonzero((key != key[0]) | (sub != sub[0]))[0])
            yield [c[:end] for c in cols], True
            cols, cut, large = [c[end:] for c in cols], cut - end, False
        if cut:
            yield [c[:cut] for c in cols], False
        held = [c[cut:] for c in cols]
        if large or len(held[0]) > limit:
            yield held, True
            large, held = True, [h[-1:] for h in held]     # one row is kept to see the bucket's end
    if held is not None and len(held[0]):
        yield held, large


def near_links(groups: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: edges that join the distinct fingerprints ``fp`` within ``max_bits`` into their components."""
    spark = groups.sparkSession
    ring = Ring(64, SEGMENTS, max_bits)

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        key = np.concatenate([ring.key(fp, s) for s in range(ring.segments)])
        return pa.RecordBatch.from_arrays([
            pa.array(key.view(np.int64)), pa.array(np.zeros(len(key), dtype=np.int64)),
            pa.array(np.tile(fp, ring.segments).view(np.int64))], names=["key", "sub", "fp"])

    def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))],
            names=["a", "b", "hot"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, fp), large in _runs(batches, bucket_rows):
            if large:
                yield rows(key, fp, True)
                continue
            ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
            size = np.diff(np.r_[0, ends])
            big = np.repeat(size > bucket_rows, size)
            if big.any():
                yield rows(key[big], fp[big], True)
            key, fp = key[~big], fp[~big]
            yield rows(*link_buckets(key, fp, key & np.uint64(15), ring), False)

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Sub-keys on the bits that the key leaves free."""
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        out_key, out_sub, out_fp = [], [], []
        for start in range(ring.segments):
            here = (key & np.uint64(15)) == np.uint64(start)
            free = [i % ring.segments for i in range(start + ring.equal, start + ring.segments)]
            x = np.zeros(int(here.sum()), dtype=np.uint64)
            for i in free:
                x = (x << np.uint64(ring.bits[i])) | ring.segment(fp[here], i)
            small = Ring(sum(ring.bits[i] for i in free), SUB_SEGMENTS, max_bits)
            for s in range(small.segments):
                out_key.append(key[here])
                out_sub.append(small.key(x, s))
                out_fp.append(fp[here])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c).view(np.int64)) for c in (out_key, out_sub, out_fp)], names=["key", "sub", "fp"])

    def compare_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, sub, fp), _ in _runs(batches, 1 << 62):
            ends = np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), True]) + 1
            size = np.diff(np.r_[0, ends])
            bucket = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= bucket_rows, size)
            yield rows(*link_buckets(bucket[small], fp[small], key[small] & np.uint64(15), ring), False)
            for i in np.flatnonzero(size > bucket_rows):
                yield rows(*link_by_masks(np.unique(fp[ends[i] - size[i]:ends[i]]), max_bits), False)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.repartition("key", "sub").sortWithinPartitions("key", "sub")

    with arrow_rows(spark, 1 << 16):
        found = written(bucketed(groups.select("fp").mapInArrow(per_batch(keyed), "key long, sub long, fp long"))
                        .mapInArrow(compare, "a long, b long, hot boolean"), "simhash-links")
        hot = found.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
        cut = written(bucketed(hot.mapInArrow(per_batch(again), "key long, sub long, fp long"))
                      .mapInArrow(compare_hot, "a long, b long, hot boolean"), "simhash-hot")
    return found.where("not hot").select("a", "b").unionAll(cut.select("a", "b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge ``(a, b)`` to another; the root is the smallest node."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = written(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "components")
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        links = written(small, "components")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is named by its smallest id."""
    session_for_text(docs.sparkSession)
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    roots = connected_components(near_links(groups, max_bits))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = written(rooted.join(named, "root").select("fp", "component_id"), "simhash-names")
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, two bits."""
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of the smallest id (null ids last, then by hashes of the row)."""
    a, b = hashes(*docs.columns)
    rows = docs.withColumn("_row", F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), a.alias("a"), b.alias("b")))
    first = simhash_components(rows, "_row").where("doc_id.a = component_id.a and doc_id.b = component_id.b") \
        .select(F.col("doc_id.a").alias("_a"), F.col("doc_id.b").alias("_b")).distinct()
    return docs.withColumn("_a", a).withColumn("_b", b).join(first, ["_a", "_b"], "left_semi") \
        .dropDuplicates(["_a", "_b"]).select(docs.columns)
