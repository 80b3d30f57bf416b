"""Small helpers for the Arrow stages of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch between Spark and Python, at most. Texts are fat rows, and a task holds some batches at a time.
BATCH_ROWS = 1000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for the operators; their session gets batches of ``BATCH_ROWS`` rows, unless it has smaller ones."""
    if not 0 < int(spark.conf.get(ROWS_SETTING, "0")) <= BATCH_ROWS:
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, name: str) -> str:
    """The DDL type of a column, to carry it through an Arrow stage unchanged."""
    return df.schema[name].dataType.simpleString()


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as their bytes; null is empty. Nothing is decoded, so no byte can fail."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts; null is empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        return [value or "" for value in column.to_pylist()]
    except UnicodeDecodeError:
        return [value.decode("utf-8", "replace") for value in raw_texts(column)]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, to bound a stage's memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of one column of texts or of lists of
    numbers, or of a single row that has more.

    Rows alone bound nothing: a few long texts would decide a stage's memory.
    """
    for batch in batches:
        own = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(own), 4) if pa.types.is_list(own.type) else pc.binary_length(own)
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(edges) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length`` of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
