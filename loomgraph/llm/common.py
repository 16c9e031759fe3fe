"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import counted, discard, materialise, shared_dir

__all__ = [
    "blocks", "counted", "crc", "discard", "doc_remainder", "fresh_name", "materialise", "popcount", "row_key", "salted_join", "shared_dir", "shuffle_width", "trim", "utf8",
]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: Column) -> Column:
    """With doc_id, names a row even where a doc_id repeats with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or longer, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def salted_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows with one lookup row a key, without a task for all rows of a hot key.

    Rows are dealt by key and a salt of their own; the salts that a key has (found by a partial aggregation) get a copy of its
    lookup row each, so that no more copies are made than there are rows.
    """
    salt = F.pmod(F.xxhash64("doc_id", "row", F.lit(11)), F.lit(max(16, shuffle_width(rows.sparkSession)))).cast("int")
    salted = rows.withColumn("_salt", salt)
    pairs = salted.select(key, "_salt").distinct().join(lookup, key)
    return salted.join(pairs, [key, "_salt"]).drop("_salt")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0))
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > limit and i > at:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trim() -> None:
    """Gives freed memory back to the system: workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
