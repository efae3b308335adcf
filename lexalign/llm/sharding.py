"""Sharding by rendezvous hashing over weighted shards.

Every shard bids for a record's key, and the highest bid has it. A bid depends on the
key, the shard's name and the shard's weight only::

    u = (first 52 bits of md5(key + "@" + name) + 0.5) / 2 ** 52      bid = weight / -ln(u)

so a shard gets records in proportion to its weight, a new shard takes records only
into itself, and the records of a shard that leaves go to the others by their weights.
The key is the id's decimal text; md5 and Spark's `ln` (StrictMath) give the same bids on
every machine. Ties of bids, which need equal hashes, go to the shard named first.

``write_shards`` puts the records with all their columns into Parquet files below
``shard=<n>``, in ascending key order: one range shuffle on (shard, key), so a shard that
holds most records is cut into as many files as it needs. A record carries the range it
is in and its place there; the ranges' counts (a row a range and shard) turn them
into slots, 0 to n - 1 in every shard.

Defined results: all records without a key have one shard, like those of any repeated
key, and come first; repeated rows get slots next to each other; null texts are
written as null and count as empty; an empty table gives empty shards. Columns ``shard``,
``grown_shard``, ``_range`` and ``_at`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexalign.llm.common import hashes, session_for_text, shuffle_width, table
from lexalign.session import scratch_path

N_SHARDS = 16
_PLACE_BITS = 33         # of monotonically_increasing_id


def shard_of(key: Column, weights: Sequence[float], names: Sequence[str] | None = None) -> Column:
    """Number of the shard (its place in ``weights``) with the highest bid for ``key``, a string."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    names = list(names) if names else [str(i) for i in range(len(weights))]
    if len(set(names)) != len(weights):
        raise ValueError("shards need names of their own, one for each weight")

    def bid(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("@"), shard["name"])), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((shard["weight"] / -F.ln(u)).alias("bid"), (-shard["at"]).alias("before"))

    shards = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at"))
                       for i, (n, w) in enumerate(zip(names, weights))])
    return (-F.array_max(F.transform(shards, bid))["before"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
           id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and, for the weights after a change, ``grown_shard``."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    out = docs.withColumn("shard", shard_of(key, weights))
    return out.withColumn("grown_shard", shard_of(key, grown) if grown else F.lit(None).cast("int"))


def write_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
                 path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all records into files by shard; returns the folder."""
    spark = docs.sparkSession
    session_for_text(spark)
    path = path or scratch_path(spark, "shards")
    tie, row = hashes(text_col)[0], F.monotonically_increasing_id()       # equal rows are dealt by their number
    placed = assign(docs.drop("_range", "_at"), weights, grown, id_col) \
        .withColumn("_tie", tie).withColumn("_row", F.xxhash64(row))
    order = [F.col("shard"), F.col(id_col).asc_nulls_first(), F.col("_tie"), F.col("_row")]
    place = F.monotonically_increasing_id()
    placed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).drop("_tie", "_row") \
        .withColumn("_range", F.shiftright(place, _PLACE_BITS).cast("int")) \
        .withColumn("_at", place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))) \
        .write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of the files, with ``shard`` and ``slot``; ``schema`` holds the written columns and ``shard int``."""
    rows = spark.read.schema(schema).parquet(path)
    ranges = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = ranges.select("shard", "_range", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"))
    # bounded: ranges are in order of shards, so there are at most ranges + shards rows
    return rows.join(F.broadcast(first), ["shard", "_range"]).withColumn("slot", F.col("_at") + F.col("_shift")) \
        .drop("_range", "_at", "_shift")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight, read back from their files, and the shard each has among 17."""
    docs = table(spark, sf_dir, "documents")
    path = write_shards(docs, [1.0] * N_SHARDS, [1.0] * (N_SHARDS + 1))
    written = "doc_id long, text string, grown_shard int, _range int, _at long, shard int"
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, path, written).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the CRC-32 of a string: each byte is folded in, then shifted eight times (-1)."""
    steps = "[('0x' || h)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]"
    return (f"xor(4294967295, list_reduce(flatten([{steps} for h in regexp_extract_all(hex(encode({text})), '..')]), "
            "lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, "
            "4294967295::BIGINT))")


ORACLE_SQL = f"""
WITH dealt AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
         list_max([{{'b': 1 / -ln({{u}}), 'i': -i}} for i in range({N_SHARDS})]).i * -1 AS shard,
         list_max([{{'b': 1 / -ln({{u}}), 'i': -i}} for i in range({N_SHARDS + 1})]).i * -1 AS grown_shard
  FROM documents)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown_shard::INT AS grown_shard
FROM dealt
""".replace("{u}", "((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '@' || i), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)")
