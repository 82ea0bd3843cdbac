"""Triangle counts over a stream of edges: each micro-batch counts the triangles that its new edges close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.patterns import count_matches


def new_triangles(old: DataFrame, new: DataFrame) -> DataFrame:
    """(n): triangles of old and new edges together, less those of the old ones. At least one edge is new: the first
    new one is at one of three places, those before it are old and those behind it are any."""
    held, added = old.toDF("src", "dst").distinct(), new.toDF("src", "dst").distinct().join(old.toDF("src", "dst"), ["src", "dst"], "left_anti")
    every = held.unionByName(added)
    total = None
    for k in range(3):
        parts = [held if i < k else added if i == k else every for i in range(3)]
        r, s, t = (p.toDF(*names) for p, names in zip(parts, (("a0", "a1"), ("a1", "a2"), ("a0", "a2")), strict=True))
        n = r.join(s, "a1").join(t, ["a0", "a2"]).agg(F.count("*").alias("n"))
        total = n if total is None else total.unionByName(n)
    return total.agg(F.sum("n").alias("n"))


def run(spark: SparkSession, edges: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Counts triangles over a streaming DataFrame (src, dst). state/edges holds all edges by batch, state/counts a row
    (batch, added) each; a batch that is run again replaces its own rows."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.toDF("src", "dst").dropna().distinct().persist()
        try:
            session.read.parquet(f"{state}/edges").limit(0)
            old = session.read.parquet(f"{state}/edges").filter(F.col("batch") < number).select("src", "dst")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        added = new_triangles(old, batch).select(F.lit(number).cast("long").alias("batch"), F.col("n").alias("added"))
        added.write.mode("overwrite").parquet(f"{state}/counts/b{number}")
        batch.write.mode("overwrite").parquet(f"{state}/edges/batch={number}")
        batch.unpersist()

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark: SparkSession, state: str) -> int:
    return spark.read.parquet(f"{state}/counts/*").agg(F.sum("added").alias("n")).first()["n"] or 0


def static_total(edges: DataFrame) -> int:
    return count_matches(edges).first()["count"]
