"""A consistent-hash ring: virtual points of nodes, and the owner of an id is that of the next point."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsets.functions import unsigned
from idsets.functions.hashing import fnv1a, fnv1a_id

#: Bits of a hash that say which part of the ring it falls into.
PART_BITS = 12


class Ring:
    def __init__(self, nodes: list[str], replicas: int = 100):
        self.nodes, self.replicas = sorted(set(nodes)), replicas
        points: dict[int, str] = {}
        for node in self.nodes:
            for k in range(replicas):
                points[fnv1a(node.encode() + k.to_bytes(4, "little"))] = node
        self.points = sorted(points.items())

    def add(self, node: str) -> Ring:
        return Ring([*self.nodes, node], self.replicas)

    def remove(self, node: str) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.replicas)

    def owner(self, id_: int) -> str | None:
        if not self.points:
            return None
        at = bisect_left(self.points, (fnv1a((id_ & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")), ""))
        return self.points[at % len(self.points)][1]

    def route(self, ids: DataFrame, column: str = "id", owner: str = "owner") -> DataFrame:
        """ids with their owner; null if the ring is empty.

        Each part of the ring, by a hash's first bits, has the list of its points and the first beyond; an equi-join with those few parts finds the
        list, and the first point that isn't below the hash is the owner's.
        """
        return routes(ids, {owner: self}, column)

    def parts(self) -> list[list[tuple[int, str | None]]]:
        """For each part of the ring its points, in unsigned order as signed numbers, and the first beyond."""
        keys, out = [p for p, _ in self.points], []
        for part in range(1 << PART_BITS):
            a, b = (bisect_left(keys, x << (64 - PART_BITS)) for x in (part, part + 1))
            beyond = self.points[b % len(self.points)][1] if self.points else None
            out.append([*((p - (1 << 63), n) for p, n in self.points[a:b]), ((1 << 63) - 1, beyond)])
        return out


def routes(ids: DataFrame, rings: dict[str, Ring], column: str = "id") -> DataFrame:
    """ids with a column for each ring, the id's owner there: one hash and one join for all of them."""
    lists = [r.parts() for r in rings.values()]
    kind = "array<struct<at:bigint,node:string>>"
    table = ids.sparkSession.createDataFrame([(part, *own) for part, own in enumerate(zip(*lists))], ", ".join(["__part int", *(f"__points{k} {kind}" for k in range(len(lists)))]))
    hashed = ids.withColumn("__hash", fnv1a_id(F.col(column))).withColumn("__part", F.shiftrightunsigned("__hash", 64 - PART_BITS).cast("int"))
    key = unsigned.order_key(F.col("__hash"))
    # 4096 rows whatever the ids, and a point list for each ring
    found = hashed.join(F.broadcast(table), "__part", "left")
    for k, name in enumerate(rings):
        found = found.withColumn(name, F.get(F.filter(f"__points{k}", lambda p: p["at"] >= key), 0)["node"])
    return found.drop("__hash", "__part", *(f"__points{k}" for k in range(len(lists))))


def balance(routed: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, n) of each owner."""
    return routed.groupBy(owner).agg(F.count("*").alias("n"))


def max_share(routed: DataFrame, owner: str = "owner") -> DataFrame:
    return balance(routed, owner).agg((F.max("n") / F.sum("n")).alias("max_share"))


def remapped(ids: DataFrame, before: Ring, after: Ring, column: str = "id") -> DataFrame:
    """total and moved: the ids whose owner differs. Both routes are found by one hash and one join."""
    both = routes(ids, {"old": before, "new": after}, column)
    return both.agg(F.count("*").alias("total"), F.sum((F.col("old") != F.col("new")).cast("bigint")).alias("moved"))


def shard_owners(spark, shards: int, ring: Ring) -> DataFrame:
    """(shard, owner) of shards 0 .. shards - 1."""
    return ring.route(spark.range(shards).withColumnRenamed("id", "shard"), "shard")
