"""Sets as bitmaps: a row (bucket, bits) for each run of 32,768 ids that has members."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 32_768
#: Rows that are extracted together.
TOGETHER = 64


def construct(ids: DataFrame) -> DataFrame:
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def intersect(sets: list[DataFrame]) -> DataFrame:
    """Bits of all sets. A bucket that a set lacks has no row there, so only buckets with a row of each set count."""
    every = reduce(lambda a, b: a.unionByName(b), sets)
    both = every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter(F.col("n") == len(sets)).select("bucket", "bits")


def union(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count(bitmap: DataFrame) -> DataFrame:
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n"))


def words(ids: DataFrame) -> DataFrame:
    """(word_idx, word): 64 ids a row, for sets that are cut into ranges of words."""
    index = F.shiftrightunsigned("id", 6)
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS int))")
    return ids.groupBy(index.alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def and_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """The words of both sets, those without a common id left out."""
    other = b.select("word_idx", F.col("word").alias("other"))
    return a.join(other, "word_idx").select("word_idx", F.col("word").bitwiseAND(F.col("other")).alias("word")).filter("word <> 0")


def count_words(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum(F.bit_count("word").cast("bigint")), F.lit(0)).alias("n"))


def extract(bitmap: DataFrame) -> DataFrame:
    """The ids of the set bits."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(k, TOGETHER)
                bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                row, at = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                bucket = batch.column("bucket").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(bucket > 0, (bucket - 1) * SPAN + at + 1, bucket * SPAN - at))], ["id"])

    return bitmap.select("bucket", "bits").mapInArrow(apply, "id bigint")


def members(bitmap: DataFrame, probes: DataFrame, column: str = "id") -> DataFrame:
    """probes with a boolean column member: the bit of each id is tested in its bucket's row."""
    place = F.bitmap_bit_position(F.col(column))
    # bytes are taken as two hexadecimal digits: substr of a binary is a binary
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    hit = F.shiftright(byte, 0).bitwiseAND(F.expr(f"shiftleft(1L, CAST(bitmap_bit_position({column}) % 8 AS int))")) != 0
    rows = probes.withColumn("__bucket", F.bitmap_bucket_number(F.col(column))).join(bitmap.select(F.col("bucket").alias("__bucket"), "bits"), "__bucket", "left")
    return rows.withColumn("member", F.coalesce(hit, F.lit(False))).drop("__bucket", "bits")


def word_ranges(ids: DataFrame, parts: int) -> DataFrame:
    """(word_idx, word) in `parts` partitions, each a range of words in their order."""
    return words(ids).repartitionByRange(parts, "word_idx").sortWithinPartitions("word_idx")
