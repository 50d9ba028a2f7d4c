"""Shared plumbing: tables, staged results in the cluster's shared folder, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import components  # noqa: F401
from ..session import dropped, prepared, shared_dir, ship, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder, by Spark's own reader."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = 3 << 18) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``most`` bytes of text (or of 64-bit numbers, for lists) each, one row at least, so that kernels need bounded memory."""
    texts = batch.column(column)
    length = pc.multiply(pc.list_value_length(texts), 8) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    size = np.asarray(pc.fill_null(length, 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column back to back (null: empty) and the offsets of its rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data
    return data, offsets - (offsets[0] if len(offsets) else 0)


def released() -> None:
    """Give a worker's freed memory back to the system at the end of a task; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict | None], schema: str, text: str | None = None) -> DataFrame:
    """``mapInArrow`` of a function from one (bounded) batch to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    prepared(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text) if text else (batch,):
                if part.num_rows and (cols := kernel(part)) is not None:
                    yield pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in target], schema=target)
        released()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
