"""Small helpers shared by the training-data operators.

Rows travel to Python as Arrow batches (`mapInArrow`), so the work per batch is
numpy or C code; Spark does the partitioning, the shuffles and the retries.
Intermediate tables go to the shared folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.session import scratch_path

#: Rows of one Arrow batch of whole texts: bounds what a Python worker holds at once.
TEXT_ROWS = 512


def session_for_text(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Settings for scans of whole texts: small Arrow batches; shuffle files go when their write is over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other batch size for the jobs that run inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a file read, not the work again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """Lift a function of one Arrow batch to the iterator that `mapInArrow` wants."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
    return run


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


_HELD: dict = {}


def worker_cache(key: tuple, make: Callable):
    """A Python worker's cache across tasks; a worker holds one, so asking for another frees it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def free_memory() -> None:
    """Hand back to the system what earlier work of this worker has freed: allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _find_trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim        # of the GNU C library
    except (OSError, AttributeError):
        return None


_TRIM = _find_trim()


def drop_worker_cache() -> None:
    """Free what an earlier stage left in this worker, before work that has no use for it."""
    _HELD.clear()
    free_memory()


def hashes(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns, which tell rows of other contents apart; nulls count by place."""
    nulls = [F.isnull(c) for c in columns]
    return [F.xxhash64(F.lit(i), *columns, *nulls) for i in range(2)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seed64(*parts: object) -> int:
    """A fixed 64-bit number from a name; used for hash seeds that do not depend on the machine."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit integers (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
