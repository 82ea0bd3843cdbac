"""Hooks for a caller's own functions: predicates, reductions, maps, row makers, comparators, bucket mappers.

Each takes Column expressions, which stay in generated code; row makers take Arrow batches where columns can't express
what they make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    return df.filter(predicate(df))


def reduce_by(df: DataFrame, keys: Sequence[str], value: str, initial: Column, merge: Callable[[Column, Column], Column], to: str = "reduced", parts: int = 16) -> DataFrame:
    """Folds each key's values with an associative, commutative function that has `initial` as its identity.

    Equal values of a key are counted before they meet, and what each makes up is folded by doubling; then `parts` parts
    of each key are folded, so a hot key's values, or copies of one, are never one list.
    """
    counted = df.groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    # n copies: the bits of n say which powers of two of the value to merge.
    step = lambda acc, _: F.struct(
        F.when(acc["n"] % 2 == 1, merge(acc["made"], acc["power"])).otherwise(acc["made"]).alias("made"), merge(acc["power"], acc["power"]).alias("power"), F.shiftright(acc["n"], 1).alias("n"),
    )
    bits = F.sequence(F.lit(1), F.length(F.bin("__n")))
    copies = F.reduce(bits, F.struct(initial.alias("made"), F.col("__value").cast(df.select(initial).schema[0].dataType).alias("power"), F.col("__n").alias("n")), step)["made"]
    part = F.pmod(F.xxhash64("__value"), F.lit(parts))
    first = counted.withColumn("__v", copies).groupBy(*keys, part.alias("__part")).agg(F.reduce(F.collect_list("__v"), initial, merge).alias("__v"))
    return first.groupBy(*keys).agg(F.reduce(F.collect_list("__v"), initial, merge).alias(to))


def transform(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def flat_map(df: DataFrame, made: Column, to: str = "made") -> DataFrame:
    """One row for each entry of an array."""
    return df.withColumn(to, F.explode(made))


def create_rows(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Any number of rows from each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch)

    return df.mapInArrow(run, schema)


def sort_by(df: DataFrame, key: Callable[[DataFrame], Column], descending: bool = False) -> DataFrame:
    return df.orderBy(key(df).desc() if descending else key(df).asc())


def join_by(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Equal keys that are computed on each side."""
    return left.withColumn("__k", left_key).join(right.withColumn("__k", right_key), "__k").drop("__k")


def sum_by(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, by: Sequence[str], value: str, to: str, n: str = "n") -> DataFrame:
    """Rows `n` of join_by and the sum of a right column, by groups of left columns. Each key's right rows are counted
    and summed before they meet the left ones, which are put together by key first, so no pairs are made."""
    held = right.groupBy(right_key.alias("__k")).agg(F.count("*").alias("__m"), F.sum(value).alias("__v"))
    rows = left.groupBy(*by, left_key.alias("__k")).agg(F.count("*").alias("__n"))
    met = rows.join(held, "__k")
    return met.groupBy(*by).agg(F.sum(F.col("__n") * F.col("__m")).alias(n), F.sum(F.col("__n") * F.col("__v")).alias(to))


def deal(df: DataFrame, n: int, by: Column | None = None, kind: str = "hash") -> DataFrame:
    """n partitions: "hash" or "range" of a key expression, or "even" without one."""
    if by is None or kind == "even":
        return df.repartition(n)
    return df.repartitionByRange(n, by) if kind == "range" else df.repartition(n, by)
