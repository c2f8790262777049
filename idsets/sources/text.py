"""Readers of id lists, JSON bodies and term files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.functions.unsigned import parsed
from idsets.operators.idset import IdSet

FAILFAST, PERMISSIVE = "failfast", "permissive"
_SEPARATORS = "[,; \\t\\r\\n]+"


def parse_ids(lines: DataFrame, mode: str = FAILFAST, comments: bool = True) -> DataFrame:
    """(id) of all tokens of the lines (value). failfast raises at a token that isn't an id; permissive drops it."""
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError(f"mode is {FAILFAST} or {PERMISSIVE}, not {mode}")
    text = F.trim(F.regexp_replace("value", "[\\r\\n\\t]", " "))
    rows = lines.select(text.alias("line")).filter("line <> ''")
    if comments:
        rows = rows.filter(~F.col("line").startswith("#"))
    tokens = rows.select(F.explode(F.split("line", _SEPARATORS)).alias("token")).filter("token <> ''")
    id_ = parsed(F.col("token"))
    if mode == FAILFAST:
        id_ = F.when(id_.isNotNull(), id_).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.col("token"))).cast("bigint"))
    return tokens.select(id_.alias("id")).filter("id IS NOT NULL") if mode == PERMISSIVE else tokens.select(id_.alias("id"))


def read_ids(spark: SparkSession, path: str, mode: str = FAILFAST) -> IdSet:
    """The ids of text files: separated by commas, semicolons or white space; blank lines and those that begin with # are skipped."""
    return IdSet.from_column(parse_ids(spark.read.text(path), mode))


def read_json_ids(bodies: DataFrame, column: str = "body") -> IdSet:
    """The ids of JSON bodies {"ids": [...]}."""
    ids = F.from_json(column, "ids array<string>")["ids"]
    return IdSet.from_column(bodies.select(F.explode(ids).alias("token")).select(parsed(F.col("token")).alias("id")))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, term) of term files: a term a line, trimmed; blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.trim("value").alias("term"))
    return lines.filter("term <> '' AND NOT startswith(term, '#')")
