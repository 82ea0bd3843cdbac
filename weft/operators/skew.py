"""Joins of skewed keys: heavy hitters, salting of heavy keys alone, and reuse of what heavy keys lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def heavy_hitters(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k commonest values and their counts, exact; of equal counts the smaller value comes first."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(k)


def heavy_hitters_approx(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k commonest values by a sketch of bounded size."""
    sketch = df.agg(F.expr(f"approx_top_k(`{key}`, {int(k)})").alias("top"))
    return sketch.select(F.explode("top").alias("x")).select(F.col("x.item").alias(key), F.col("x.count").alias("count"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Values that more than `share` of all rows have: 1 / share values at most, so safe to broadcast."""
    total = df.agg(F.count("*").alias("n")).first()["n"]
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > share * total).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, share: float = 0.001) -> DataFrame:
    """Inner join on a key that is skewed on the left: rows of heavy keys are spread over `salts` partitions by the hash
    of their columns (equal rows stay together) and the right side's rows of those keys, and of no others, are repeated
    for each. Without heavy keys it is a plain join."""
    found = [r[0] for r in heavy_keys(left, key, share).limit(int(1 / share) + 1).collect()]  # 1 / share at most
    if not found:
        return left.join(right, key)
    heavy = F.col(key).isin(found)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    none = F.lit(0).cast("long")
    a = left.withColumn("__salt", F.when(heavy, spread).otherwise(none))
    every = F.sequence(none, F.lit(salts - 1).cast("long"))
    b = right.withColumn("__salt", F.explode(F.when(heavy, every).otherwise(F.array(none))))
    return a.join(b, [key, "__salt"]).drop("__salt")


def heavy_light_join(left: DataFrame, key: str, suffix: list[DataFrame], share: float = 0.001) -> DataFrame:
    """left joined with a chain of relations that begins at `key`. For heavy keys the chain's result is computed once
    for each distinct key, written, and joined back; light rows run through the chain as they are."""
    heavy = F.broadcast(heavy_keys(left, key, share))

    def chain(rows: DataFrame) -> DataFrame:
        for r in suffix:
            on = [c for c in r.columns if c in rows.columns]
            if not on:
                raise ValueError("the chain must follow from the key alone")
            rows = rows.join(r, on)
        return rows

    once = checkpointed(chain(heavy.select(key)))
    hot = left.join(heavy, key, "left_semi").join(once, key)
    light = chain(left.join(heavy, key, "left_anti"))
    return hot.select(*light.columns).unionByName(light)
