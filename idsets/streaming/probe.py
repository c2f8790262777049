"""Streams against stored sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from idsets.operators.idset import IdSet


def members_of(stream: DataFrame, column: str, ids: IdSet) -> DataFrame:
    """The rows of a stream whose column is in a stored set. Without state: each batch is a semi-join with the set as it is then."""
    stored = ids.df.withColumnRenamed("id", "__id")
    return stream.join(stored, stream[column] == stored["__id"], "left_semi")
