"""Synthetic relations; every generator is a plan over spark.range, so rows are made where they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, *salt: Column) -> Column:
    """A number in [0, 1) from a hash of the row's number: the same in every run and on every retry."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), *salt), 11) / F.lit(float(1 << 53))


def uniform(spark: SparkSession, n: int, low: int, high: int, seed: int = 1, name: str = "a0") -> DataFrame:
    """n values of [low, high)."""
    return spark.range(n).select((F.floor(_unit(seed) * (high - low)) + low).cast("int").alias(name))


def cyclic(spark: SparkSession, n: int, span: int, seed: int = 1, name: str = "a0") -> DataFrame:
    """id mod span in a random order: every value occurs equally often, give or take one."""
    return spark.range(n).orderBy(F.xxhash64(F.lit(seed), "id")).select((F.col("id") % span).cast("int").alias(name))


def zipf_weights(spark: SparkSession, span: int, alpha: float, seed: int) -> DataFrame:
    """(value, lo, hi): ranges of [0, 1) whose widths follow rank^-alpha; ranks are dealt to values by a hash."""
    from ..operators.primitives import scan

    ranks = spark.range(span).select((F.col("id") + 1).alias("rank"), F.pow(F.col("id") + 1, F.lit(-alpha)).alias("w"))
    total = ranks.agg(F.sum("w").alias("t")).first()["t"]
    summed = scan(ranks, ["rank"], F.col("w") / total, "hi")
    dealt = scan(spark.range(span).select(F.col("id").alias("value"), F.xxhash64(F.lit(seed), "id").alias("h")), ["h", "value"], F.lit(1), "rank")
    return summed.join(dealt, "rank").select("value", (F.col("hi") - F.col("w") / total).alias("lo"), F.when(F.col("rank") == span, 2.0).otherwise(F.col("hi")).alias("hi"))


def zipf(spark: SparkSession, n: int, low: int, span: int, alpha: float, seed: int = 1, name: str = "a0", keep: Sequence[Column] = ()) -> DataFrame:
    """n values of [low, low + span), the k-th commonest with a weight of k^-alpha.

    Numbers meet their range by way of equal cells of [0, 1): a range lies in few cells, so no pair of a number and a
    far range is ever made.
    """
    cells = max(1, min(span, 1 << 16))
    ranges = zipf_weights(spark, span, alpha, seed)
    in_cells = F.sequence(F.floor(F.greatest("lo", F.lit(0.0)) * cells), F.floor(F.least("hi", F.lit(1.0)) * cells))
    ranges = ranges.withColumn("cell", F.explode(in_cells))
    drawn = spark.range(n).select("id", _unit(seed + 7).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    met = drawn.join(ranges, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select(*keep, (F.col("value") + low).cast("int").alias(name))


def generate_relation(spark: SparkSession, n: int, columns: Sequence[dict], seed: int = 1) -> DataFrame:
    """A relation with a column for each spec: {"attr": k, "low": a, "high": b} uniform, with "alpha" a Zipf column."""
    out = spark.range(n)
    for k, spec in enumerate(columns):
        name, low, high = f"a{spec['attr']}", spec["low"], spec["high"]
        if spec.get("alpha"):
            held = zipf(spark, n, low, high - low, spec["alpha"], seed + k, name, [F.col("id")])
            out = out.join(held, "id")
        else:
            out = out.withColumn(name, (F.floor(_unit(seed + k) * (high - low)) + low).cast("int"))
    return out.drop("id")


def unique_pairs(spark: SparkSession, n: int, low: int, high: int, seed: int = 1) -> DataFrame:
    """Exactly n distinct pairs (a0, a1) of [low, high) squared: more are drawn until enough are distinct."""
    span = high - low
    if n > span * span:
        raise ValueError("fewer pairs exist")
    if 2 * n > span * span:  # dense: a random choice among all pairs
        every = spark.range(span * span).orderBy(F.xxhash64(F.lit(seed), "id")).limit(n)
        return every.select((F.floor(F.col("id") / span) + low).cast("int").alias("a0"), (F.col("id") % span + low).cast("int").alias("a1"))
    drawn = n
    while True:
        drawn = int(drawn * 1.5) + 16
        pairs = generate_relation(spark, drawn, [{"attr": 0, "low": low, "high": high}, {"attr": 1, "low": low, "high": high}], seed).distinct()
        if pairs.count() >= n:
            return pairs.orderBy(F.xxhash64(F.lit(seed), "a0", "a1"), "a0", "a1").limit(n)


def sequential_pairs(spark: SparkSession, n: int, span: int) -> DataFrame:
    """(0, 0), (0, 1), ... of span values a side."""
    return spark.range(n).select(F.floor(F.col("id") / span).cast("int").alias("a0"), (F.col("id") % span).cast("int").alias("a1"))


def skewed_pairs(spark: SparkSession, n: int, span: int, alpha: float, skewed: int = 0, seed: int = 1) -> DataFrame:
    """Distinct pairs out of n drawn ones, one column of which is Zipf."""
    columns = [{"attr": k, "low": 0, "high": span} | ({"alpha": alpha} if k == skewed else {}) for k in range(2)]
    return generate_relation(spark, n, columns, seed).distinct()


def triangle_relations(spark: SparkSession, n: int, span: int, alpha: float = 0.0, seed: int = 1) -> list[DataFrame]:
    """R(a0, a1), S(a1, a2), T(a0, a2) of distinct pairs."""
    made = [skewed_pairs(spark, n, span, alpha, 0, seed + k) if alpha else unique_pairs(spark, n, 0, span, seed + k) for k in range(3)]
    return [r.toDF(*names) for r, names in zip(made, (("a0", "a1"), ("a1", "a2"), ("a0", "a2")), strict=True)]


def primary_keys(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(key, payload): each of 1..n once, in a random order."""
    return spark.range(n).orderBy(F.xxhash64(F.lit(seed), "id")).select((F.col("id") + 1).cast("int").alias("key"), F.col("id").cast("int").alias("payload"))


def foreign_keys(spark: SparkSession, n: int, keys: int, seed: int = 1) -> DataFrame:
    """(key, payload): n rows over 1..keys, each key equally often, in a random order."""
    return spark.range(n).orderBy(F.xxhash64(F.lit(seed), "id")).select((F.col("id") % keys + 1).cast("int").alias("key"), F.col("id").alias("payload"))
