"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import run_dir, tuned

BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a new folder of the shared directory and read them back: later steps repeat no work."""
    path = run_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its measured bytes stay below the limit; else leave the join to Catalyst."""
    return F.broadcast(df) if (df.agg(F.sum(size + 16)).first()[0] or 0) <= limit else df


def give_back() -> None:
    """Return freed memory to the system. Python workers are reused: what a task leaves is missing in the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def groups(column, limit: int = 1 << 22):
    """Texts of an Arrow column in groups of about ``limit`` characters: (first row, texts)."""
    low, held, size = 0, [], 0
    for value in column:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= limit:
            yield low, held
            low, held, size = low + len(held), [], 0
    if held:
        yield low, held


def coded(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words, and the place of each word among them."""
    found = pa.array(words, pa.large_string()).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def taken(values: pa.LargeBinaryArray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of the values at these places in a row, and where each begins; the last entry is the end."""
    got = values.take(pa.array(at, pa.int64()))
    _, offsets, data = got.buffers()
    return memoryview(data if data is not None else b""), np.frombuffer(offsets, np.int64)[: len(at) + 1] if len(at) else np.zeros(1, np.int64)


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, *keep: str) -> DataFrame:
    """Map Arrow batches; ``work`` gives the new columns, ``keep`` names those passed through unchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    full = StructType([*(df.schema[c] for c in keep), *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = work(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*keep, *arrow.names])

    return df.mapInArrow(run, full)
