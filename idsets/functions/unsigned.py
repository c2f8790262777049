"""Unsigned 64-bit ids in BIGINT columns: the bit pattern is the id; equality needs nothing, order and text do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def order_key(id_: Column) -> Column:
    """A signed column in the ids' unsigned order; its own inverse."""
    return id_.bitwiseXOR(F.lit(SIGN))


def least(id_: Column) -> Column:
    return order_key(F.min(order_key(id_)))


def greatest(id_: Column) -> Column:
    return order_key(F.max(order_key(id_)))


def shown(id_: Column) -> Column:
    """The id as DECIMAL(20,0)."""
    return F.when(id_ >= 0, id_.cast("decimal(20,0)")).otherwise(id_.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")


def parsed(token: Column) -> Column:
    """The id that a token of decimal digits names; null for anything else, and from 2 ** 64 on."""
    digits = F.when(token.rlike("^[0-9]+$"), F.regexp_replace(token, "^0+(?=[0-9])", ""))
    value = F.when(F.length(digits) <= 20, digits).cast("decimal(20,0)")
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(value < top, value.cast("bigint")).when(value < F.lit("18446744073709551616").cast("decimal(20,0)"), (value - top - top).cast("bigint"))
