"""Tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_left: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, the context's checkpoint folder, or on a local master a temporary one. Elsewhere it must be set."""
    sc = spark.sparkContext
    if (path := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them and the driver share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="idsets-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later plans start there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it takes it)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        if path := table.__dict__.pop("_scratch", None):
            _left.pop(path, None)
            fs, where = file_system(table.sparkSession, path)
            fs.delete(where, True)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new name of a managed table, which is dropped when the program ends."""
    table = f"idsets_{name}_{uuid.uuid4().hex}"
    _tables[table] = spark
    return table


@atexit.register
def _clean() -> None:
    """Tables that results may still have read until now. Where the session has ended, only those on this machine can go."""
    for table, spark in _tables.items():
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path, spark in _left.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                fs, where = file_system(spark, path)
                fs.delete(where, True)
            else:
                shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
