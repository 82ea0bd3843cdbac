"""Column functions: hashes and digits of keys, powers of two, dates, strings, searches in sorted arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_32 = (1 << 32) - 1


def low_bits(key: Column, bits: int) -> Column:
    return key.bitwiseAND((1 << bits) - 1)


def radix_digit(key: Column, offset: int, bits: int) -> Column:
    return F.shiftright(key, offset).bitwiseAND((1 << bits) - 1)


def times_32(a: Column, factor: int) -> Column:
    """a * factor mod 2^32 for 0 <= a < 2^32, from 16-bit halves, so that no step leaves 64 bits."""
    low = a.bitwiseAND(0xFFFF) * F.lit(factor)
    high = F.shiftleft((F.shiftrightunsigned(a, 16) * F.lit(factor)).bitwiseAND(0xFFFF), 16)
    return (low.bitwiseAND(MASK_32) + high).bitwiseAND(MASK_32)


#: The public 32-bit finaliser of Murmur3.
MURMUR_FACTORS = (0x85EBCA6B, 0xC2B2AE35)


def murmur_finaliser(key: Column, capacity: int | None = None) -> Column:
    """Murmur3's 32-bit finaliser of a key's low 32 bits; with a capacity, modulo it."""
    h = key.cast("long").bitwiseAND(MASK_32)
    for shift, factor in zip((16, 13), MURMUR_FACTORS, strict=True):
        h = times_32(h.bitwiseXOR(F.shiftrightunsigned(h, shift)), factor)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return h if capacity is None else h % capacity


def linear_hash(key: Column, a: int, b: int, prime: int, size: int) -> Column:
    """((a * key + b) mod prime) mod size, exactly, for any 64-bit key."""
    wide = "decimal(38,0)"
    return F.pmod(F.pmod(key.cast(wide) * F.lit(a).cast(wide) + F.lit(b).cast(wide), F.lit(prime).cast(wide)), F.lit(size).cast(wide)).cast("long")


def range_bucket(key: Column, low: int, high: int, buckets: int) -> Column:
    """Equal ranges of [low, high]; keys outside go to the nearest."""
    at = F.floor((key - low) * buckets / (high - low + 1))
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at)).cast("int")


def modulo_bucket(key: Column, skip_bits: int, buckets: int) -> Column:
    return F.pmod(F.shiftright(key, skip_bits), F.lit(buckets)).cast("int")


def floor_power_of_2(x: Column) -> Column:
    """Largest power of two that isn't above x, for x >= 1: by bits, not by a rounded logarithm."""
    filled = x.cast("long")
    for k in (1, 2, 4, 8, 16, 32):
        filled = filled.bitwiseOR(F.shiftrightunsigned(filled, k))
    return filled - F.shiftrightunsigned(filled, 1)


def is_power_of_2(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def ceil_power_of_2(x: Column) -> Column:
    low = floor_power_of_2(x)
    return F.when(low == x, low).otherwise(low * 2)


def log2_floor(x: Column) -> Column:
    return F.bit_count(floor_power_of_2(x) - 1)


def date_to_int(d: Column) -> Column:
    """YYYYMMDD."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def decode(value: Column, *pairs, default=None) -> Column:
    """decode(value, a, x, b, y, default=z): x where value is a, y where it is b, else z."""
    out = F.lit(default)
    for key, to in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
        out = F.when(value.eqNullSafe(F.lit(key)), F.lit(to)).otherwise(out)
    return out


def lower_bound(values: Column, x: Column) -> Column:
    """Number of entries of an array that are less than x: where x would go in a sorted one."""
    return F.size(F.filter(values, lambda v: v < x))


def upper_bound(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def order_key_hash(key: Column) -> Column:
    """Order keys of the public generator use 8 of every 32 numbers: without the two unused bits they are dense."""
    return F.shiftleft(F.shiftright(key, 5), 3).bitwiseOR(key.bitwiseAND(7))
