"""Bit, hash and time helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_bits(x: Column, start: int, n: int) -> Column:
    """n bits of x from bit ``start`` up."""
    return F.shiftrightunsigned(x.cast("bigint"), start).bitwiseAND(F.lit((1 << n) - 1))


def branch(x: Column, level: int) -> Column:
    """The child an id takes at a level of a four-way tree over its low bits."""
    return get_bits(x, 2 * level, 2)


def fingerprint(x: Column) -> Column:
    """The low byte of an id."""
    return F.pmod(x, F.lit(256))


def xor_fold(x: Column) -> Column:
    """A bigint folded to one byte by XOR of its halves, thrice."""
    x = x.cast("bigint")
    for width in (32, 16, 8):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, width))
    return x.bitwiseAND(F.lit(255))


def bit_set(x: Column, k: int) -> Column:
    return x.bitwiseOR(F.lit(1 << k))


def bit_clear(x: Column, k: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << k)))


def bit_flip(x: Column, k: int) -> Column:
    return x.bitwiseXOR(F.lit(1 << k))


def bit_test(x: Column, k: int) -> Column:
    return get_bits(x, k, 1) == 1


def popcount(x: Column) -> Column:
    """Bits of x that are 1."""
    return F.bit_count(x)


def first_zero(x: Column, width: int) -> Column:
    """The lowest bit of ``width`` that is 0, or -1 if all are 1."""
    low = F.bitwise_not(x).bitwiseAND(x + 1)
    place = F.bit_count(low - 1)
    return F.when((low == 0) | (place >= width), -1).otherwise(place)


def timestamp_number(at: Column | None = None) -> Column:
    """A time as the number yyyyMMddHHmmss."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMddHHmmss").cast("bigint")


def date_text(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd")


def time_text(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "HH:mm:ss")
