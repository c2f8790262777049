"""What the operators of this subpackage share: tables, names, splits and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.plans.storage import discard, scratch, shared_dir, written  # noqa: F401

#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but `own` under names that no operator uses, and what gives a result of it the columns of docs again."""
    names = {c: c if c in own else f"__c{k}" for k, c in enumerate(docs.columns)}
    moved = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return moved, lambda df: df.select(*(F.col(n).alias(c) for c, n in names.items()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together."""
    at, _ = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, min(end, batch.num_rows) - first)
        first = end


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_state: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task for one operator and its parameters; another key takes its place, so that a worker holds one at a time."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def release() -> None:
    """Drops what the worker keeps; for operators that need the memory and keep nothing."""
    _state.clear()
