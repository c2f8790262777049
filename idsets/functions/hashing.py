"""Wrapping 64-bit hashes as column expressions, in 32-bit limbs so that ANSI arithmetic never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits: the offset basis, and the prime 2**40 + 435.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211

_LOW = (1 << 32) - 1


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def times_plus(a: Column, factor: int, add: Column) -> Column:
    """a * factor + add modulo 2 ** 64, for factors and addends below 2 ** 31."""
    low = a.bitwiseAND(F.lit(_LOW)) * F.lit(factor).cast("bigint") + add
    high = F.shiftrightunsigned(a, 32) * F.lit(factor).cast("bigint") + F.shiftrightunsigned(low, 32)
    return _join(high, low)


def positional_id(term: Column) -> Column:
    """The sum of (code point + byte offset + 1) * 31 ** place over a term's characters, modulo 2 ** 64; 0 for the empty term.

    For terms, not documents: each place takes a prefix of the term.
    """
    digit = lambda i: (F.ascii(F.substring(term, i, 1)) + F.octet_length(F.substring(term, 1, i - 1)) + 1).cast("bigint")
    # Horner's scheme from the last character
    sequence = F.sequence(F.char_length(term), F.lit(1), F.lit(-1))
    value = F.aggregate(F.transform(sequence, digit), F.lit(0).cast("bigint"), lambda a, d: times_plus(a, 31, d))
    return F.when(F.char_length(term) > 0, value).when(term.isNotNull(), F.lit(0).cast("bigint"))


def fnv1a_id(id_: Column) -> Column:
    """FNV-1a over the id's eight bytes, the lowest first. A fold, as each step uses the one before several times."""

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        factor = F.lit(FNV_PRIME & _LOW).cast("bigint")
        low = x.bitwiseAND(F.lit(_LOW)) * factor
        # x * 2**40 reaches the high limb alone, with 24 bits of x
        high = F.shiftrightunsigned(x, 32) * factor + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return _join(high, low)

    raw = F.array(*(F.shiftrightunsigned(id_, 8 * k).bitwiseAND(F.lit(255).cast("bigint")) for k in range(8)))
    return F.aggregate(raw, F.lit(FNV_BASIS - (1 << 64)).cast("bigint"), step)


def fnv1a(raw: bytes) -> int:
    """FNV-1a of a few bytes, on the driver."""
    h = FNV_BASIS
    for b in raw:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h
