"""The engine's functions for SQL: positional_id, fnv1a_id, id_text, owners of a ring, and sets as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from idsets.functions.hashing import FNV_BASIS, FNV_PRIME
from idsets.operators.idset import IdSet
from idsets.operators.ring import Ring

_LOW = (1 << 32) - 1
#: Two limbs of 32 bits as one number; see functions.hashing.
_JOIN = f"(shiftleft(({{high}}) & {_LOW}L, 32) | (({{low}}) & {_LOW}L))"
_TIMES_31 = _JOIN.format(high=f"shiftrightunsigned(a, 32) * 31L + shiftrightunsigned((a & {_LOW}L) * 31L + d, 32)", low=f"(a & {_LOW}L) * 31L + d")
_FNV_LOW = f"((h ^ b) & {_LOW}L) * {FNV_PRIME & _LOW}L"
_FNV_STEP = _JOIN.format(high=f"shiftrightunsigned(h ^ b, 32) * {FNV_PRIME & _LOW}L + shiftrightunsigned({_FNV_LOW}, 32) + shiftleft((h ^ b) & {(1 << 24) - 1}L, 8)", low=_FNV_LOW)

FUNCTIONS = {
    "positional_id(term STRING) RETURNS BIGINT": f"""CASE WHEN term IS NULL THEN NULL WHEN char_length(term) = 0 THEN 0L ELSE aggregate(
        transform(sequence(char_length(term), 1, -1), i -> CAST(ascii(substring(term, i, 1)) + octet_length(substring(term, 1, i - 1)) + 1 AS BIGINT)), 0L, (a, d) -> {_TIMES_31}) END""",
    "fnv1a_id(id BIGINT) RETURNS BIGINT": f"aggregate(transform(sequence(0, 56, 8), k -> shiftrightunsigned(id, k) & 255L), {FNV_BASIS - (1 << 64)}L, (h, b) -> {_FNV_STEP})",
    "id_text(id BIGINT) RETURNS STRING": "CAST(CASE WHEN id >= 0 THEN CAST(id AS DECIMAL(20,0)) ELSE CAST(id AS DECIMAL(20,0)) + 18446744073709551616BD END AS STRING)",
}


def register(spark: SparkSession) -> None:
    """The functions, as temporary ones of the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def register_ring(spark: SparkSession, name: str, ring: Ring) -> None:
    """name(id): the owner on the ring, null on an empty one. The points are a constant of the function."""
    register(spark)
    points = ", ".join(f"named_struct('at', {p - (1 << 63)}L, 'node', '{n}')" for p, n in ring.points)
    first = f"'{ring.points[0][1]}'" if ring.points else "NULL"
    at = f"get(filter(array({points}), p -> p.at >= (fnv1a_id(id) ^ CAST(-9223372036854775808 AS BIGINT))), 0).node" if ring.points else "CAST(NULL AS STRING)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(id BIGINT) RETURNS STRING RETURN coalesce({at}, {first})")


def register_set(name: str, ids: IdSet) -> None:
    """The set as a view with the column id, for IN, EXISTS and joins."""
    ids.df.createOrReplaceTempView(name)
