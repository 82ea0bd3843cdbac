"""Joins of a large table with few keys, in which rows that surely have no partner aren't shuffled.

The few keys set bits of a bitmap of BITS bits, which is a table of at most BITS / 32768 rows of 4 kB (8 MB, whatever
the number of keys) and is broadcast; rows whose bit is unset pass by, the others are joined exactly. With more keys
than bits can tell apart it is an ordinary shuffled join. No Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import hold

BITS = 1 << 26


def split(rows: DataFrame, key: Column, few: DataFrame, few_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no key in `few`, and the others; both with the column __key."""
    place = lambda k: F.pmod(k, F.lit(BITS)) + 1  # noqa: E731 - bitmaps count from 1
    set_bits = few.select(place(F.col(few_key)).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__part"))
    bitmap = hold(set_bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits")), "bitmap")
    keyed = rows.withColumn("__key", key)
    bit = place(F.col("__key"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = keyed.withColumn("__part", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "__part", "left")
    may = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    marked = marked.withColumn("__may", may).drop("__part", "__bits")
    return marked.filter(~F.col("__may")).drop("__may"), marked.filter("__may").drop("__may")
