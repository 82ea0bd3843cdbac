"""A checksum of a result that doesn't depend on the order of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 20


def value_histogram(df: DataFrame, bits: int = BITS) -> DataFrame:
    """(value, count): all columns' values, cut to their low bits, and how often each occurs. Partial counts are
    summed, so at most 2^bits rows a task are shuffled."""
    flat = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("long") for c in df.columns])).alias("v")).filter("v is not null")
    return flat.groupBy(F.col("v").bitwiseAND((1 << bits) - 1).alias("value")).agg(F.count("*").alias("count"))


def checksum(df: DataFrame, bits: int = BITS) -> DataFrame:
    """One row: md5 of "value:count" joined by commas in the order of values. The list has 2^bits entries at most."""
    entry = F.struct("value", F.concat_ws(":", F.col("value").cast("string"), F.col("count").cast("string")).alias("s"))
    held = value_histogram(df, bits).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return held.select(F.md5(F.array_join(F.transform("x", lambda e: e["s"]), ",")).alias("md5"))


def deciles(df: DataFrame, bits: int = BITS) -> DataFrame:
    """(value, count, share): running share of all values up to each, over at most 2^bits rows."""
    counts = value_histogram(df, bits)
    running = F.sum("count").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("value", "count", F.floor((running * 10 - 1) / total).cast("int").alias("decile"))
