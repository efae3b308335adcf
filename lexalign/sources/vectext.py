"""Embedding text files (``.vec``): header ``count dim`` then ``word v1 … vdim``.

Row order is semantic (the id is the frequency rank).  The scan is a DataFrame
over text splits, which are ordered by file and offset. A first pass counts the lines of
every split and notes the scan's running number at its start; the second turns running
numbers into line numbers by a lookup of these few rows, so no text is shuffled.
Caps, case folding and vocabulary filters work on words and line numbers alone; vectors are
joined to what is left.

Gzip input (``.vec.gz``) is read by Spark's codec; a gzip file is one split,
so the rows are repartitioned right after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexalign.functions import ranking
from lexalign.functions.formatting import format_vec_g6
from lexalign.session import materialise

WS = r"(?U)[\s\x1c-\x1f]+"   # Python str.split() semantics: Unicode white space and the separators
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"   # what Python's str.strip() takes away


def _ordered_paths(spark: SparkSession, path: str) -> str:
    """A directory written by ``write_vec`` is read part by part in name order."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(hpath).isDirectory():
        return path
    names = sorted(str(s.getPath().toString()) for s in fs.listStatus(hpath)
                   if s.getPath().getName().startswith("part-"))
    return ",".join(names)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line bigint, value string)`` with ``line`` = 0-based position in the file(s)."""
    df = read_files(spark, [path]).drop("path")
    if path.endswith(".gz"):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


#: Splits whose first lines are looked up in a broadcast table; with more, the lookup is a shuffled join.
MOST_SPLITS = 200_000


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, line bigint, value string)`` of several files in one scan, lines numbered in each.

    ``monotonically_increasing_id`` counts on through the lines of a split, in whichever task it is, and
    both passes plan the same splits. So a line's number is its running number less that of
    its split's first line, plus the lines of the splits before.
    """
    listed = [_ordered_paths(spark, p) for p in paths]
    parts = [(p, i, part) for p, names in zip(paths, listed) for i, part in enumerate(names.split(","))]
    files = spark.createDataFrame([(p, i, _file_name(spark, f)) for p, i, f in parts],
                                  "path string, part int, file string").withColumn("file", _plain(F.col("file")))
    text = spark.read.text(sorted({f for _, _, f in parts})).select(
        _plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    splits = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).join(F.broadcast(files), "file")
    ends = Window.partitionBy("path").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(splits.select("path", "file", "block", (F.coalesce(F.sum("n").over(ends), F.lit(0)) - F.col("first")).alias("shift")),
                         "splits")           # a row a split
    few = starts.count() <= MOST_SPLITS
    return text.join(F.broadcast(starts) if few else starts, ["file", "block"]) \
               .select("path", (F.col("at") + F.col("shift")).cast("bigint").alias("line"), "value")


def _file_name(spark: SparkSession, path: str) -> str:
    """The full name of a file, as its scan reports it (see ``_plain``)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hpath).toUri().toString()


def _plain(name):
    """File names with and without an empty authority are the same."""
    return F.regexp_replace(name, "^([a-z0-9+.-]+:)/+", "$1/")


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    """``(count, dim)`` from the first line (read without scanning the file)."""
    first = spark.sparkContext.textFile(_ordered_paths(spark, path)).first()
    parts = first.split()
    return int(parts[0]), int(parts[1])


def scan(spark: SparkSession, path: str, expect_dim: int | None = None) -> DataFrame:
    """All rows of a ``.vec`` file: ``(line, word, vec array<double>)``, ``line`` 1-based.

    Rows whose vector length differs from the header dimension raise an error.
    """
    count, dim = header(spark, path)
    dim = expect_dim or dim
    inside = (F.col("line") >= 1) & (F.col("line") <= count)
    parts = F.split(F.col("value"), " ", 2)
    vec = F.transform(F.split(F.trim(parts[1]), WS), lambda x: x.cast("double"))
    out = read_lines(spark, path).where(inside).select("line", parts[0].alias("word"), vec.alias("vec"))
    wrong = F.raise_error(F.concat(F.lit("vector length differs from header in line "), F.col("line").cast("string")))
    # the check may run before the filter of lines: it must not speak of others
    return out.withColumn("vec", F.when((F.size("vec") == dim) | ~inside, F.col("vec")).otherwise(wrong))


def load(rows: DataFrame, max_voc: int = 0, threshold: int = 0, vocabulary: DataFrame | None = None,
         count: int | None = None, legacy_bypass: bool = False, dense: bool = False) -> DataFrame:
    """The loader's rules over scanned rows ``(line, word, vec)``.

    * ``threshold > 0``: only the first ``threshold`` rows;
    * ``max_voc > 0``: the first ``max_voc`` distinct lower-cased words in file
      order, first spelling's vector, word lower-cased, at any number of rows;
      ``legacy_bypass=True`` drops cap, folding and de-duplication together if
      the file has fewer than ``max_voc`` rows (the only case that needs ``count``);
    * ``vocabulary``: keep only rows whose word is in the set (applied before
      the cap);
    * ids are re-packed ``0..n-1`` in file order.
    Returns ``(idx, word, vec, line)``. Only words and line numbers are shuffled to find out what stays; the
    vectors meet it in one join. ``dense`` says that lines are ``1..n`` (as a scan's are), so that
    loading all of them needs no numbering.
    """
    df = rows if threshold <= 0 else rows.where(F.col("line") <= threshold)
    cap = max_voc
    if legacy_bypass and max_voc:
        n_rows = count if count is not None else df.count()
        if min(n_rows, threshold or n_rows) < max_voc:
            cap = 0
    if dense and vocabulary is None and not cap:
        return df.select((F.col("line") - 1).cast("bigint").alias("idx"), "word", "vec", "line")
    words = df.select("line", "word")
    if vocabulary is not None:
        words = words.join(vocabulary.select("word").distinct(), "word", "left_semi").select("line", "word")
    if cap:         # the first line of every folded word: a partial aggregate
        words = words.groupBy(F.lower("word").alias("word")).agg(F.min("line").alias("line"))
    numbered = ranking.row_number_global(words, [F.col("line").asc()], "_pos")
    if cap:
        numbered = numbered.where(F.col("_pos") <= cap)
    kept = numbered.select((F.col("_pos") - 1).cast("bigint").alias("idx"), "word", "line")
    return df.select("line", "vec").join(kept, "line").select("idx", "word", "vec", "line")


def read(spark: SparkSession, path: str, max_voc: int = 0, threshold: int = 0,
         vocabulary: DataFrame | None = None, legacy_bypass: bool = False) -> DataFrame:
    """Scan + load: ``(idx, word, vec)`` (``vec`` in double)."""
    count, _ = header(spark, path)
    rows = scan(spark, path)
    return load(rows, max_voc, threshold, vocabulary, count=count, legacy_bypass=legacy_bypass, dense=True) \
        .select("idx", "word", "vec")


def read_vocab(spark: SparkSession, path: str, max_voc: int = 0) -> DataFrame:
    """Words only of the first ``max_voc`` lines, no folding or de-duplication."""
    count, _ = header(spark, path)
    lines = read_lines(spark, path).where((F.col("line") >= 1) & (F.col("line") <= count))
    if max_voc:
        lines = lines.where(F.col("line") <= max_voc)
    return lines.select((F.col("line") - 1).cast("bigint").alias("idx"),
                        F.split(F.col("value"), " ", 2)[0].alias("word"))


def to_lines(emb: DataFrame, dim: int, count: int) -> DataFrame:
    """``(key, text)`` lines of a ``.vec`` file, header first (``key = -1``)."""
    spark = emb.sparkSession
    head = spark.createDataFrame([(-1, f"{count} {dim}")], "key bigint, text string")
    body = emb.select(F.col("idx").cast("bigint").alias("key"),
                      F.concat_ws(" ", F.col("word"), format_vec_g6(F.col("vec"))).alias("text"))
    return head.unionByName(body)


def write_vec(emb: DataFrame, path: str) -> None:
    """Write ``(idx, word, vec)`` as a ``.vec`` directory: parts in line order, ``%.6g`` values.

    Range partitioning on the id keeps the line order across part files; no
    single task receives the whole table.
    """
    stats = emb.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    lines = to_lines(emb, int(stats["d"] or 0), int(stats["n"]))
    lines.repartitionByRange("key").sortWithinPartitions("key").select("text") \
        .write.mode("overwrite").text(path)
