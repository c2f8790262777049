"""IdSet: a set of 64-bit ids as a lazy DataFrame of one distinct, non-null BIGINT column."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.functions import unsigned
from idsets.operators import bitmaps
from idsets.plans import planner


def signed(id_: int) -> int:
    """The bit pattern of an id in 0 .. 2 ** 64 - 1."""
    if not 0 <= id_ < 1 << 64:
        raise ValueError(f"not an unsigned 64-bit id: {id_}")
    return id_ - (1 << 64) if id_ >> 63 else id_


class IdSet:
    """Each operation returns a new set; none runs a job but count, has, ids and choose."""

    def __init__(self, df: DataFrame, origin: tuple[DataFrame, str, Column] | None = None, repeated: DataFrame | None = None):
        """df: column id, distinct and without nulls. See from_column where that isn't so yet.

        origin: the table, key and predicate that the set is a facet of, if the key is unique there; facets of one table combine without a join.
        repeated: the same ids before repeats went. Where a set only tests or feeds a later distinct, that is enough, and no aggregate is spent on it.
        """
        self.df, self.origin, self.repeated = df, origin, repeated if repeated is not None else df

    # building

    @classmethod
    def from_column(cls, df: DataFrame, column: str | Column = "id", unique: bool = False) -> IdSet:
        """The values of a column. unique: they are known to be distinct, so no shuffle is spent on that."""
        c = F.col(column) if isinstance(column, str) else column
        ids = df.select(c.cast("bigint").alias("id")).filter("id IS NOT NULL")
        return cls(ids) if unique else cls(ids.distinct(), repeated=ids)

    @classmethod
    def facet(cls, df: DataFrame, predicate: Column | str, id_column: str, unique: bool = False) -> IdSet:
        """The ids of the rows for which a predicate holds; predicate and column reach the scan."""
        test = F.expr(predicate) if isinstance(predicate, str) else predicate
        own = cls.from_column(df.filter(test), id_column, unique)
        return cls(own.df, (df, id_column, test) if unique else None, own.repeated)

    def _same_table(self, other: IdSet) -> bool:
        return self.origin is not None and other.origin is not None and self.origin[0] is other.origin[0] and self.origin[1] == other.origin[1]

    def _refaceted(self, predicate: Column) -> IdSet:
        return IdSet.facet(self.origin[0], predicate, self.origin[1], unique=True)

    @classmethod
    def of(cls, spark: SparkSession, ids: Iterable[int]) -> IdSet:
        return cls(spark.createDataFrame([(signed(i),) for i in set(ids)], "id bigint"))

    @classmethod
    def empty(cls, spark: SparkSession) -> IdSet:
        return cls.of(spark, ())

    def add(self, *ids: int) -> IdSet:
        return self if not ids else self.union(IdSet.of(self.df.sparkSession, ids))

    # reading

    def count(self) -> int:
        return self.df.count()

    def has(self, id_: int) -> bool:
        return bool(self.df.filter(F.col("id") == F.lit(signed(id_))).take(1))

    def ids(self) -> list[int]:
        """All ids in ascending unsigned order, on the driver."""
        return [r[0] & 0xFFFFFFFFFFFFFFFF for r in self.ordered().collect()]

    def ordered(self) -> DataFrame:
        return self.df.orderBy(unsigned.order_key(F.col("id")))

    def info(self) -> DataFrame:
        """members, bytes at eight an id, least and greatest id: one row."""
        i = F.col("id")
        return self.df.agg(F.count("*").alias("members"), (F.count("*") * 8).alias("bytes"), unsigned.least(i).alias("min_id"), unsigned.greatest(i).alias("max_id"))

    def members(self, probes: DataFrame, column: str = "id") -> DataFrame:
        """probes with a boolean column member; null ids are not members."""
        hit = self.df.select(F.col("id").alias("__hit"))
        return probes.join(hit, probes[column] == F.col("__hit"), "left").withColumn("member", F.col("__hit").isNotNull()).drop("__hit")

    def search(self, batch: DataFrame, ordinal: str = "ordinal", column: str = "id") -> DataFrame:
        """(ordinal, id) of the batch's ids in the set: each once, at its first place, in the order of the batch."""
        first = batch.groupBy(F.col(column).alias("id")).agg(F.min(ordinal).alias("ordinal"))
        return first.join(self.repeated, "id", "left_semi").select("ordinal", "id").orderBy("ordinal")

    # algebra

    def intersect(self, *others: IdSet) -> IdSet:
        """The ids in all the sets, by semi-joins; inputs are distinct, so no aggregate follows. Facets of one table become one filter of it."""
        sets: list[IdSet] = []
        for s in (self, *others):
            at = next((k for k, x in enumerate(sets) if x._same_table(s)), None)
            if at is None:
                sets.append(s)
            else:
                sets[at] = sets[at]._refaceted(sets[at].origin[2] & s.origin[2])
        # the set that the others filter is one without repeats, if there is one
        at = next((k for k, s in enumerate(sets) if s.repeated is s.df), 0)
        first, rest = sets[at], sets[:at] + sets[at + 1 :]
        return IdSet(reduce(lambda a, b: a.join(b.repeated, "id", "left_semi"), rest, first.df), None if rest else first.origin)

    def intersect_dense(self, *others: IdSet) -> IdSet:
        """The same by bitmaps: shuffles a row for each 32,768 ids that lie together instead of the ids."""
        return IdSet(bitmaps.extract(bitmaps.intersect([bitmaps.construct(s.df) for s in (self, *others)])))

    def intersect_auto(self, *others: IdSet) -> IdSet:
        """The same by what planner.cheapest says. The sets are read once, into a table that has their sizes and that the plan reads; semi-joins begin with the smallest set."""
        sets = planner.gathered([s.df for s in (self, *others)])
        dense, order = planner.cheapest(sets)
        if dense:
            return IdSet(bitmaps.extract(bitmaps.intersect([bitmaps.construct(s) for s in sets])))
        first, *rest = (IdSet(sets[k]) for k in order)
        return first.intersect(*rest)

    def union(self, *others: IdSet) -> IdSet:
        if others and all(self._same_table(s) for s in others):
            return self._refaceted(reduce(lambda p, s: p | s.origin[2], others, self.origin[2]))
        return IdSet.from_column(reduce(lambda a, b: a.unionByName(b), (s.repeated for s in others), self.repeated)) if others else self

    def difference(self, *others: IdSet) -> IdSet:
        out = self
        for s in others:
            if out._same_table(s):
                out = out._refaceted(out.origin[2] & ~F.coalesce(s.origin[2], F.lit(False)))
            else:
                out = IdSet(out.df.join(s.repeated, "id", "left_anti"))
        return out

    def filter(self, mask: IdSet) -> IdSet:
        return self.intersect(mask)

    def intersect_count(self, other: IdSet) -> DataFrame:
        """n: how many ids are in both. One row."""
        return self.intersect(other).df.agg(F.count("*").alias("n"))


def intersect(*sets: IdSet, spark: SparkSession | None = None) -> IdSet:
    """The ids in all sets; none of no sets."""
    return sets[0].intersect(*sets[1:]) if sets else IdSet.empty(spark or SparkSession.active())


def union(*sets: IdSet, spark: SparkSession | None = None) -> IdSet:
    return sets[0].union(*sets[1:]) if sets else IdSet.empty(spark or SparkSession.active())
