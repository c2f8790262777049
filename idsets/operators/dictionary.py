"""Exact dictionaries: terms or keys <-> dense ids 0 .. n-1 in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsets.functions.hashing import positional_id
from idsets.operators.idset import IdSet
from idsets.plans.storage import written


def dense_ids(rows: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """rows with their place in the order, from 0 without gaps.

    Rows are sorted in ranges; a range's rows are counted, and the ranges' totals, a row each, give the ids before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "dense")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def first_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, first) of the different non-null keys: the least ordinal of each."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ordinal).alias("first"))


class Keyer:
    """Terms <-> ids: a DataFrame (term, id)."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def build(cls, terms: DataFrame, ordinal: str = "ordinal") -> Keyer:
        """From (ordinal, term) rows; the first of equal terms counts, the empty term is a term."""
        return cls(dense_ids(first_of_each(terms, "term", ordinal), "first", "term").select("term", "id"))

    def __len__(self) -> int:
        return self.df.count()

    def lookup(self, terms: DataFrame) -> DataFrame:
        """terms with their id, null where the dictionary lacks the term."""
        return terms.join(self.df, "term", "left")

    def terms(self, ids: DataFrame) -> DataFrame:
        """ids with their term, null out of range."""
        return ids.join(self.df, "id", "left")

    def id_set(self, terms: DataFrame) -> tuple[IdSet, DataFrame]:
        """The ids of the terms, and the rows of terms that are missing, in their own order and number."""
        found = terms.join(self.df, "term").select("id")
        return IdSet.from_column(found), terms.join(self.df, "term", "left_anti")


    def sizes(self) -> DataFrame:
        """terms, bytes (of the terms and eight for an id), bits_per_term, and collisions: the terms that share a positional hash with an earlier one. One row."""
        size = F.sum(F.octet_length("term") + 8)
        return self.df.agg(F.count("*").alias("terms"), size.alias("bytes"), (F.lit(8.0) * size / F.count("*")).alias("bits_per_term"), (F.count("*") - F.countDistinct(positional_id(F.col("term")))).alias("collisions"))


class Index:
    """Keys <-> dense ids: a DataFrame (key, dense_id). Lookups are exact: absent keys give null."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def build(cls, keys: DataFrame) -> Index:
        """From (ordinal, key) rows."""
        return cls(dense_ids(first_of_each(keys, "key", "ordinal"), "first", "key", name="dense_id").select("key", "dense_id"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.df, "key", "left")

    def __len__(self) -> int:
        return self.df.count()
