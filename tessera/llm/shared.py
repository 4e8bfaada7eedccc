"""Helpers of the corpus operators: shared tables and Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import mark, release, shared_dir, table

__all__ = ["CHUNK_BYTES", "SENT_IDS", "chunks", "crc_mod", "mark", "read", "release", "shared_dir", "table", "texts"]

#: Bytes of text that a NumPy kernel works on at once (a longer text is alone).
CHUNK_BYTES = 1 << 20
#: Ids that are sent to all tasks at most; beyond that, rows are joined by a shuffle.
SENT_IDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n: the folds of labelled rows."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and their n + 1 offsets; null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


_trim = _trimmer()


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together. What kernels
    have freed goes back to the system at the end, as workers live on between tasks."""
    n, at = batch.num_rows, 0
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()
    _trim(0)
