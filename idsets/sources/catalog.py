"""Named sets as a table (set_name, id), a Parquet folder for each name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.operators.idset import IdSet


class UnknownSet(KeyError):
    pass


def _checked(name: str) -> str:
    if not 1 <= len(name.encode()) <= 65535 or "/" in name:
        raise ValueError(f"not a set name: {name!r}")
    return name


class Catalog:
    """Names and members below a path; the last put of a name counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        from urllib.parse import quote

        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/set_name={quote(_checked(name), safe='')}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        from urllib.parse import unquote

        path, files = self._folder("x")
        top = path.getParent()
        if not files.exists(top):
            return []
        found = [s.getPath().getName() for s in files.listStatus(top)]
        return sorted(unquote(n.removeprefix("set_name=")) for n in found if n.startswith("set_name="))

    def put(self, name: str, ids: IdSet) -> int:
        """Writes the set beside the old one, then renames it into place, and returns its count: a write that fails leaves the old set."""
        path, files = self._folder(name)
        beside, old = (f"{self.path}/.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
        ids.df.write.parquet(beside)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if files.exists(path) and not files.rename(path, hadoop(old)):
            raise OSError(f"can't move {path}")
        if not files.rename(hadoop(beside), path):
            raise OSError(f"can't move {beside}")
        files.delete(hadoop(old), True)
        return self.get(name).count()

    def get(self, name: str) -> IdSet:
        path, files = self._folder(name)
        if not files.exists(path):
            raise UnknownSet(name)
        return IdSet(self.spark.read.schema("id bigint").parquet(path.toString()))

    def drop(self, name: str) -> None:
        path, files = self._folder(name)
        if not files.delete(path, True):
            raise UnknownSet(name)

    def table(self) -> DataFrame:
        """(set_name, id) of all sets."""
        if not self.names():
            return self.spark.createDataFrame([], "set_name string, id bigint")
        # Spark takes each escaped byte of a folder's name for a character
        name = F.decode(F.encode("set_name", "ISO-8859-1"), "UTF-8")
        return self.spark.read.schema("id bigint, set_name string").parquet(self.path).select(name.alias("set_name"), "id")

    def list(self) -> DataFrame:
        """(set_name, members), by name."""
        return listing(self.table())

    def has(self, name: str, id_: int) -> bool:
        return self.get(name).has(id_)

    def _several(self, names: list[str]) -> list[IdSet]:
        if len(names) < 2:
            raise ValueError("two names or more are needed")
        return [self.get(n) for n in names]

    def intersect(self, names: list[str]) -> IdSet:
        first, *rest = self._several(names)
        return first.intersect(*rest)

    def union(self, names: list[str]) -> IdSet:
        first, *rest = self._several(names)
        return first.union(*rest)

    def difference(self, names: list[str]) -> IdSet:
        first, *rest = self._several(names)
        return first.difference(*rest)


def listing(table: DataFrame) -> DataFrame:
    """(set_name, members) of a long table of distinct rows."""
    return table.groupBy("set_name").agg(F.count("*").alias("members")).orderBy("set_name")


def intersect_named(table: DataFrame, names: list[str]) -> IdSet:
    """The ids that a long table of distinct rows has under all the names: one aggregate for any number of sets."""
    different = sorted(set(names))
    hit = table.filter(F.col("set_name").isin(different)).groupBy("id").agg(F.count("*").alias("n"))
    return IdSet(hit.filter(F.col("n") == len(different)).select("id"))


def store_bucketed(ids: IdSet, table: str, buckets: int) -> None:
    """A managed table bucketed and sorted by id: two with the same buckets join without a shuffle."""
    ids.df.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
