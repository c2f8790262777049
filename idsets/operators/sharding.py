"""Sets over a universe that is cut into shards of equal width."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idsets.functions.unsigned import order_key, shown
from idsets.operators import bitmaps
from idsets.operators.idset import IdSet, signed


@dataclass(frozen=True)
class Shape:
    universe: int
    shards: int

    def __post_init__(self) -> None:
        if self.universe <= 0 or self.shards <= 0:
            raise ValueError("a shape needs a universe and shards")

    @property
    def bits(self) -> int:
        """Ids of a shard."""
        return -(-self.universe // self.shards)

    @property
    def sparse_below(self) -> int:
        """A shard with fewer ids is smaller as a list than as bits."""
        return self.bits // 64

    def shard_of(self, id_: Column) -> Column:
        """id // bits of unsigned ids: those from 2 ** 63 on are divided as decimals."""
        if self.bits >= 1 << 63:
            return F.when(id_ < 0, F.lit((1 << 63) // self.bits)).otherwise(F.lit(0)).cast("int")
        beyond = F.call_function("div", shown(id_), F.lit(str(self.bits)).cast("decimal(20,0)"))
        return F.when(id_ >= 0, F.call_function("div", id_, F.lit(self.bits).cast("bigint"))).otherwise(beyond).cast("int")

    def inside(self, id_: Column) -> Column:
        """Whether the unsigned id is below the shards' end."""
        end = self.bits * self.shards
        return F.lit(True) if end >= 1 << 64 else order_key(id_) < F.lit(end - (1 << 63))


class ShardedSet:
    """(shard, id) rows; ids outside the shape are left out."""

    def __init__(self, ids: IdSet, shape: Shape):
        self.shape = shape
        i = F.col("id")
        self.df = ids.df.filter(shape.inside(i)).select(shape.shard_of(i).alias("shard"), "id")

    def has(self, id_: int) -> bool:
        """Looks at one shard."""
        if not 0 <= id_ < self.shape.bits * self.shape.shards:
            return False
        return bool(self.df.filter((F.col("shard") == id_ // self.shape.bits) & (F.col("id") == signed(id_))).take(1))

    def counts(self) -> DataFrame:
        """(shard, n) of all shards, empty ones too."""
        every = self.df.sparkSession.range(self.shape.shards).select(F.col("id").cast("int").alias("shard"))
        return every.join(self.df.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))

    def modes(self) -> DataFrame:
        """(shard, n, mode): the smaller of the two representations of each shard."""
        return self.counts().withColumn("mode", F.when(F.col("n") < self.shape.sparse_below, "sparse").otherwise("dense"))

    def bytes(self) -> DataFrame:
        """(shard, mode, bytes): eight for an id or for 64 ids of the shard's width."""
        words = -(-self.shape.bits // 64)
        return self.modes().select("shard", "mode", F.when(F.col("mode") == "sparse", F.col("n") * 8).otherwise(F.lit(words * 8)).cast("bigint").alias("bytes"))

    def intersect_counts(self, other: ShardedSet) -> DataFrame:
        """(shard, n) of the shards with ids in both sets. The shapes must be the same."""
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape} and {other.shape}")
        return self.df.join(other.df, ["shard", "id"], "left_semi").groupBy("shard").agg(F.count("*").alias("n"))

    def intersect_counts_by_mode(self, other: ShardedSet) -> DataFrame:
        """(shard, modes, n) of the shards with ids in both sets, each counted as its two modes ask: by words where both are dense, by ids otherwise."""
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape} and {other.shape}")
        # a row for each shard
        pairs = self.modes().select("shard", F.col("mode").alias("a")).join(other.modes().select("shard", F.col("mode").alias("b")), "shard").select("shard", F.concat_ws("-", "a", "b").alias("modes"))
        own, its = (s.df.join(F.broadcast(pairs), "shard") for s in (self, other))
        dense = F.col("modes") == "dense-dense"
        words = bitmaps.and_words(bitmaps.words(own.filter(dense)), bitmaps.words(its.filter(dense)))
        # a word lies in one shard where the width is a number of words
        split = self.shape.bits % 64
        if split:
            dense = F.lit(False)
        listed = own.filter(~dense).join(its.filter(~dense), ["shard", "id"], "left_semi").groupBy("shard", "modes").agg(F.count("*").alias("n"))
        if split:
            return listed
        first = F.shiftleft("word_idx", 6)
        counted = words.select(self.shape.shard_of(first).alias("shard"), F.lit("dense-dense").alias("modes"), F.bit_count("word").cast("bigint").alias("n"))
        return listed.unionByName(counted.groupBy("shard", "modes").agg(F.sum("n").alias("n")))

    def intersect_count(self, other: ShardedSet) -> DataFrame:
        return self.intersect_counts(other).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
