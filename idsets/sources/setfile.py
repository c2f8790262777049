"""Portable set files, read and encoded by executors; a folder of them is a catalog of named sets.

A file is MAGIC, KIND, the number of ids, and the ids in ascending order, integers of eight bytes with the lowest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.functions.unsigned import order_key
from idsets.operators.idset import IdSet
from idsets.plans.storage import discard, file_system, written

# Fixed values of the file format.
MAGIC = b"SXSET1"
KIND = b"S"
SUFFIX = ".sxset"

HEAD = len(MAGIC) + len(KIND) + 8


def encode(ids: np.ndarray) -> bytes:
    """The file of ids as unsigned numbers in any order."""
    ids = np.unique(np.asarray(ids, np.uint64))
    return MAGIC + KIND + len(ids).to_bytes(8, "little") + ids.astype("<u8").tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The ids of a file; ValueError says why it isn't one. Bytes after the last id are ignored."""
    if len(raw) < HEAD or raw[: len(MAGIC)] != MAGIC:
        raise ValueError("too short, or another format")
    if raw[len(MAGIC) : len(MAGIC) + 1] != KIND:
        raise ValueError("not a set")
    n = int.from_bytes(raw[HEAD - 8 : HEAD], "little")
    if n > (len(raw) - HEAD) // 8:
        raise ValueError("fewer ids than it says")
    ids = np.frombuffer(raw, "<u8", n, HEAD)
    if (ids[1:] <= ids[:-1]).any():
        raise ValueError("ids are not in strictly ascending order")
    return ids


def read_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(set_name, id, error) of the files of a path or folder: a file's stem is its set's name. A bad file gives one row with its error and no id, or raises if strict."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path).select("path", "content")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = name.rsplit("/", 1)[-1].removesuffix(SUFFIX)
                try:
                    ids, error = decode(raw).view("<i8"), None
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{name}: {e}") from None
                    ids, error = np.zeros(1, "<i8"), str(e)
                step = 1 << 20
                for k in range(0, max(len(ids), 1), step):
                    part = ids[k : k + step]
                    column = pa.array(part, pa.int64()) if error is None else pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), column, pa.array([error] * len(part), pa.string())], ["set_name", "id", "error"])

    return files.mapInArrow(apply, "set_name string, id bigint, error string")


def read_set(spark: SparkSession, path: str) -> IdSet:
    """The set of one file; raises if the file is bad."""
    return IdSet(read_files(spark, path, strict=True).select("id"))


#: Ids of a block that an executor encodes.
BLOCK = 1 << 20


def write_set(ids: IdSet, path: str) -> None:
    """One file, in any file system that Spark knows. Executors sort the ids in ranges and encode them in blocks of BLOCK; the driver puts the blocks one after another."""
    spark = ids.df.sparkSession

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, kept, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            kept.append(batch.column("k").to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
            held += batch.num_rows
            if held >= BLOCK:
                yield _block(part, at, kept)
                at, kept, held = at + 1, [], 0
        if held:
            yield _block(part, at, kept)

    ordered = ids.df.select(order_key(F.col("id")).alias("k")).repartitionByRange("k").sortWithinPartitions("k")
    blocks = written(ordered.mapInArrow(encoded, "part int, at int, n bigint, bytes binary"), "set_blocks")
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(MAGIC + KIND + n.to_bytes(8, "little")))
        for r in blocks.orderBy("part", "at").toLocalIterator():  # a block at a time
            out.write(bytearray(r.bytes))
    finally:
        out.close()
    discard(blocks)


def _block(part: int, at: int, kept: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(kept)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u8").tobytes()], pa.binary())], ["part", "at", "n", "bytes"])
