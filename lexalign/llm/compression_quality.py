"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built, from texts labelled good and from texts
labelled bad. A text is cut into stretches of ``STRETCH`` bytes, so that the
dictionaries matter over its whole length, and each is compressed with both. The
difference of the compressed sizes, over the size of the text, is turned with the text's length into
a probability by a logistic curve fitted on labelled texts that are in neither dictionary, the classes weighted by
how many of each are labelled.

Only the fit uses labels, from a bounded sample: the ``SAMPLE_DOCS`` labelled rows
of each class with the smallest hashes of their ids. The dictionaries see ``SAMPLE_BYTES``
of each text at most, in stretches spread over its whole length; the curve is fitted on
differences of whole texts, computed by Spark. Scoring is one pass over whole texts with two dictionaries of
``DICTIONARY_BYTES`` in the closure: no shuffle, no join.

Defined results: null and empty texts score as a difference of zero; repeated rows
score alike; several labels for one id count as good if any is; null ids are scored
and are not held out; without labels of both classes every score is the share of
good labels (one half without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.llm.common import session_for_text, table, utf8

SAMPLE_DOCS = 3000
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 16
STRETCH = 1 << 10
LEVEL = 3


class Pair:
    """Compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        # frames without content size, checksum or dictionary id: only the content differs
        of = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False,
                                       write_dict_id=False) for d in (good, bad)]
        self.good, self.bad = (c.compress for c in of)

    def difference(self, text: bytes) -> float:
        """Sizes with the bad dictionary less sizes with the good one, over the length."""
        if not text:
            return 0.0
        gap = 0
        for at in range(0, len(text), STRETCH):
            part = text[at:at + STRETCH]
            gap += len(self.bad(part)) - len(self.good(part))
        return gap / len(text)


def features(differences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the curve goes by: the difference, the length's logarithm and their product, as short texts scatter more."""
    size = np.log1p(np.asarray(lengths, dtype=float))
    return np.stack([differences, size, differences * size], axis=1)


class Classifier:
    """Dictionaries and the curve from difference and length to probability."""

    def __init__(self, good: bytes, bad: bytes, slopes: np.ndarray, offset: float):
        self.good, self.bad, self.slopes, self.offset = good, bad, np.asarray(slopes, dtype=float), offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pair = Pair(self.good, self.bad) if self.good else None
        x = np.array([pair.difference(t) if pair else 0.0 for t in texts])
        at = features(x, np.array([len(t) for t in texts])) @ self.slopes + self.offset
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve over the columns of ``x``, by Newton steps on standardised values."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    middle, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.concatenate([(x - middle) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * len(x),
                               a.T @ (weight * (y - p)) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * middle / scale).sum())


def held_out(doc_id: str):
    """True for the third of ids that no fit may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _spread(text: str):
    """The binary column ``text``, or of long values stretches from the start to the end."""
    n = SAMPLE_BYTES // STRETCH
    starts = [f"cast({i}L * (octet_length({text}) - {STRETCH}) div {n - 1} as int) + 1" for i in range(n)]
    some = ", ".join(f"substring({text}, {at}, {STRETCH})" for at in starts)
    return F.expr(f"case when octet_length({text}) <= {SAMPLE_BYTES} then {text} else concat({some}) end")


def _known(labels: DataFrame) -> DataFrame:
    """``(doc_id, quality)`` of the labels that a fit may see."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id")) \
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))


def class_sizes(labels: DataFrame) -> dict[int, int]:
    """Labelled documents of each class that a fit may see: the sample's classes are weighted by them."""
    return {r["quality"]: r["count"] for r in _known(labels).groupBy("quality").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[int, bytes, int]]:
    """``(quality, text, doc_id)`` of the bounded sample, in the order of a hash of the ids; long texts in stretches."""
    known = _known(labels).withColumn("turn", F.xxhash64("doc_id"))
    picked = None
    for quality in (0, 1):
        some = known.where(F.col("quality") == quality).orderBy("turn", "doc_id").limit(sample_docs)
        picked = some if picked is None else picked.unionAll(some)
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).join(F.broadcast(picked), "doc_id") \
        .select("quality", "turn", "doc_id", _spread("text").alias("text")) \
        .groupBy("doc_id", "quality", "turn").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: (r["turn"], r["doc_id"]))
    return [(r["quality"], bytes(r["text"] or b""), r["doc_id"]) for r in found]


def whole_differences(docs: DataFrame, ids: list[int], good: bytes, bad: bytes) -> dict[int, tuple[float, int]]:
    """The differences and lengths of the whole texts of ``ids`` (the least of rows that share an id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(good, bad)
        for batch in batches:
            texts = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pair.difference(t) for t in texts], pa.float64()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "x", "n"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {id_type}")
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi") \
        .mapInArrow(run, f"doc_id {id_type}, x double, n long")
    return {r["doc_id"]: tuple(r["found"]) for r in rows.groupBy("doc_id").agg(F.min(F.struct("x", "n")).alias("found")).collect()}


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the stretches of texts; of raw text where there is too little to train on."""
    parts = [t[i:i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def fit(sample: list[tuple[int, bytes, int]], docs: DataFrame | None = None, sizes: dict[int, int] | None = None) -> Classifier:
    """Dictionaries from every second text of each class, the curve from the others: from their whole texts in ``docs``.

    The curve weighs the classes by ``sizes``, the numbers of all that are labelled, as the sample has other shares of them.
    """
    by_class = {q: [(t, i) for k, t, i in sample if k == q and t] for q in (0, 1)}
    if min(map(len, by_class.values())) < 4:
        share = np.clip((len(by_class[1]) + 0.5) / (len(by_class[0]) + len(by_class[1]) + 1), 0.01, 0.99)
        return Classifier(b"", b"", np.zeros(3), float(np.log(share / (1 - share))))
    # both dictionaries come from as much text, so that neither knows more of the language
    n = min(len(x) for x in by_class.values()) // 2
    good, bad = (_dictionary([t for t, _ in by_class[q][:n]]) for q in (1, 0))
    rest = [(q, t, i) for q in (0, 1) for t, i in by_class[q][n:]]
    if docs is None:
        pair = Pair(good, bad)
        found = [(pair.difference(t), len(t)) for _, t, _ in rest]
    else:
        whole = whole_differences(docs, [i for *_, i in rest], good, bad)
        found = [whole[i] for *_, i in rest]
    y = np.array([q for q, *_ in rest], dtype=float)
    weight = np.ones(len(y)) if sizes is None else np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    slopes, offset = _logistic(features(*map(np.array, zip(*found))), y, weight)
    return Classifier(good, bad, slopes, offset)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = classifier.scores(utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels that are not held out."""
    session_for_text(spark)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return score(docs, fit(labelled_sample(docs, labels), docs, class_sizes(labels)))
