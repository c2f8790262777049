"""The choice between bitmaps and semi-joins, from sizes and the greatest id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsets.functions import unsigned
from idsets.plans.storage import written

#: Bytes that the bitmaps of all sets may have.
DENSE_BYTES = 128 << 20


@dataclass(frozen=True)
class Plan:
    dense: bool
    order: list[int]
    universe: int
    sizes: list[int]


def is_dense(k: int, universe: int, total: int) -> bool:
    """Whether the words to read and write for k bitmaps are fewer than the ids of the sets."""
    words = universe // 64 + 1
    return k >= 2 and universe > 0 and (2 * k - 1) * words < total and k * words * 8 <= DENSE_BYTES


def statistics(sets: list[DataFrame]) -> DataFrame:
    """(number, size, max_id) of each set that has ids."""
    every = reduce(lambda a, b: a.unionByName(b), (s.select("id", F.lit(k).alias("number")) for k, s in enumerate(sets)))
    return every.groupBy("number").agg(F.count("*").alias("size"), unsigned.greatest(F.col("id")).alias("max_id"))


def choose(sets: list[DataFrame]) -> Plan:
    """The plan of an intersection, by one job over the sets; a row for each set comes back."""
    sizes, greatest = [0] * len(sets), -1
    for r in statistics(sets).collect():
        sizes[r.number] = r.size
        greatest = max(greatest, r.max_id & 0xFFFFFFFFFFFFFFFF)
    dense = all(sizes) and is_dense(len(sets), greatest + 1, sum(sizes))
    return Plan(dense, sorted(range(len(sets)), key=lambda k: sizes[k]), greatest + 1, sizes)


#: Bytes of a bitmap's row, and of an id's.
ROW_BYTES, ID_BYTES = 4096, 8


def gathered(sets: list[DataFrame]) -> list[DataFrame]:
    """The sets as parts of one written table: each source is read once."""
    every = reduce(lambda a, b: a.unionByName(b), (s.select(F.lit(k).alias("number"), "id") for k, s in enumerate(sets)))
    table = written(every, "gathered")
    return [table.filter(F.col("number") == k).select("id") for k in range(len(sets))]


def cheapest(sets: list[DataFrame]) -> tuple[bool, list[int]]:
    """(whether bitmaps shuffle fewer bytes than the ids, the sets from the smallest on), from the sizes and the occupied runs of ids."""
    every = reduce(lambda a, b: a.unionByName(b), (s.select("id", F.lit(k).alias("number")) for k, s in enumerate(sets)))
    found = {r.number: r for r in every.groupBy("number").agg(F.count("*").alias("n"), F.approx_count_distinct(F.bitmap_bucket_number("id")).alias("runs")).collect()}  # a row for each set
    sizes = [found[k].n if k in found else 0 for k in range(len(sets))]
    runs = [found[k].runs if k in found else 0 for k in range(len(sets))]
    return sum(runs) * ROW_BYTES < sum(sizes) * ID_BYTES, sorted(range(len(sets)), key=lambda k: sizes[k])


def dense_column(k: Column, universe: Column, total: Column) -> Column:
    """is_dense over columns."""
    words = F.floor(universe / F.lit(64)) + 1
    return (k >= 2) & (universe > 0) & ((2 * k - 1) * words < total) & (k * words * 8 <= DENSE_BYTES)
