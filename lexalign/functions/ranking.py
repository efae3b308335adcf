"""Global ranks without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row into one
task.  Here the rows are range-partitioned on the order key (Spark samples the
key distribution, composite keys included, so a hot leading value is split on
the later columns), sorted inside each range and written once with their place
(``monotonically_increasing_id``: the range and the position in it).  One count
per range shifts the positions.  That is one shuffle; the written table keeps the
numbers fixed if a task runs again.

The rows are written before they are dealt: they are counted, as a range has ``RANGE_ROWS`` rows or so
however many there are, and sampled, and would be computed anew for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexalign.session import default_parallelism, materialise


_POSITION_BITS = 33      # of monotonically_increasing_id
#: Rows that a task sorts, about.
RANGE_ROWS = 1 << 18


def range_count(df: DataFrame) -> int:
    """Ranges of about ``RANGE_ROWS`` rows, one for each core at least."""
    return max(2, default_parallelism(df.sparkSession), -(-df.count() // RANGE_ROWS))


def _ranged(df: DataFrame, order: Sequence[Column], n_ranges: int | None) -> DataFrame:
    """Rows with ``_range`` and the 0-based ``_at`` in it."""
    df = materialise(df, "unranked")
    n = n_ranges or range_count(df)
    place = F.monotonically_increasing_id()
    placed = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", place), "ranks")
    return (placed.withColumn("_range", F.shiftright("_place", _POSITION_BITS))
                  .withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))).drop("_place"))


def _offsets(ranged: DataFrame, weight: Column) -> DataFrame:
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("_tot"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: a bounded, tiny window
    return totals.select("_range", F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_off"))


def row_number_global(df: DataFrame, order: Sequence[Column], out: str = "row_no",
                      n_ranges: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order`` (ties must be broken by the caller)."""
    ranged = _ranged(df, order, n_ranges)
    offs = _offsets(ranged, F.lit(1))
    return (ranged.join(F.broadcast(offs), "_range")
                  .withColumn(out, (F.col("_off") + F.col("_at") + 1).cast("bigint"))
                  .drop("_range", "_at", "_off"))


def average_rank(df: DataFrame, col: str, out: str, n_ranges: int | None = None) -> DataFrame:
    """Fractional rank of ``col`` (ties get the mean of their positions), 1-based; null ranks as null.

    Distinct values are ranked, so a value held by many rows is one row here; a hot
    value on the way back is a skewed join, which adaptive execution splits.
    """
    d = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranged = _ranged(d, [F.col(col).asc()], n_ranges)
    w = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_below", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    offs = _offsets(ranged, F.col("_c"))
    ranks = (local.join(F.broadcast(offs), "_range")
                  .select(col, (F.col("_off") + F.col("_below") + (F.col("_c") + 1) / 2.0).alias(out)))
    return df.join(ranks, col, "left")
