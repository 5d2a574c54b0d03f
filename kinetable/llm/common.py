"""Helpers that the training-data operators share: tables, words, Arrow batches, stable mixing."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetable.scratch import new_folder, written
from kinetable.shipping import ship

__all__ = ["QUERIES", "ORACLES", "query", "table", "written", "new_folder", "two_columns", "blobs", "lowered_words", "mix64", "slices", "free_name", "ALNUM", "ascii_lower"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Byte table of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over A-Z-lowered text: other bytes become blanks.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Texts go to the Python workers in Arrow batches of this size, unless the application set another.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ready(spark: SparkSession) -> None:
    """Prepare a session for the operators: the package on the executors, and batches that long texts don't swell."""
    ship(spark)
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def two_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (null: empty), whatever else the table holds."""
    return df.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered_words(data: bytes) -> list[bytes]:
    """A-Z lowered, split at everything below 0x80 that is no letter or digit."""
    return data.translate(ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each (one row at least).

    Memory that Arrow no longer uses is given back at the end, as workers live on for other stages.
    """
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
    release_memory()


def release_memory() -> None:
    """Give back what Arrow and the allocator hold but don't use, as workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
