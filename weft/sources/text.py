"""Edge lists and delimited tables: readers with pushed projections and filters, converters, writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columnar import write_columnar


def read_edge_list(spark: SparkSession, path: str, drop_self_loops: bool = False, strict: bool = True) -> DataFrame:
    """(src, dst) from lines of two numbers, separated by blanks, tabs or bars. Empty lines and comments (#, %) are left
    out; any other line is an error, or left out too if not strict (malformed_lines counts them)."""
    pairs = _edge_lines(spark, path)
    good = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if strict:
        error = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
        pairs = pairs.select(*[F.when(good, F.col(c)).otherwise(error.cast("int")).alias(c) for c in ("src", "dst")])
    else:
        pairs = pairs.filter(good).select("src", "dst")
    return pairs.filter("src <> dst") if drop_self_loops else pairs


def malformed_lines(spark: SparkSession, path: str) -> int:
    """Lines of an edge list that are neither edges nor empty nor comments."""
    return _edge_lines(spark, path).filter("src is null or dst is null").count()


def _edge_lines(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"[ \t|]+")
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^([#%].*)?$"))
    return lines.select("value", F.get(parts, 0).try_cast("int").alias("src"), F.get(parts, 1).try_cast("int").alias("dst"))


def edge_list_to_columnar(spark: SparkSession, path: str, directory: str, **options) -> list[str]:
    """An edge list as binary columns a0, a1."""
    return write_columnar(read_edge_list(spark, path, **options).toDF("a0", "a1"), directory)


def reverse_edges(edges: DataFrame) -> DataFrame:
    src, dst = edges.columns[:2]
    return edges.select(F.col(dst).alias(src), F.col(src).alias(dst))


def read_table(spark: SparkSession, path: str, columns: Sequence[int], names: Sequence[str], types: Sequence[str], sep: str = "|", drop_self_loops: bool = False, where: Column | None = None) -> DataFrame:
    """Chosen columns (from 0) of a delimited file, named and cast; the predicate is applied in the scan's stage."""
    raw = spark.read.option("sep", sep).csv(path)
    out = raw.select(*[F.col(raw.columns[k]).cast(t).alias(n) for k, n, t in zip(columns, names, types, strict=True)])
    if where is not None:
        out = out.filter(where)
    return out.filter(F.col(names[0]) != F.col(names[1])) if drop_self_loops else out


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file as one row n."""
    return spark.read.text(path).agg(F.count("*").alias("n"))


def write_delimited(df: DataFrame, path: str, sep: str = " ", compression: str = "none") -> None:
    df.write.mode("overwrite").option("sep", sep).option("compression", compression).csv(path)


def table_to_columnar(spark: SparkSession, path: str, columns: Sequence[int], attributes: Sequence[int], directory: str, sep: str = "|") -> list[str]:
    names = [f"a{k}" for k in attributes]
    return write_columnar(read_table(spark, path, columns, names, ["int"] * len(names), sep), directory)


def table_to_tsv(spark: SparkSession, path: str, columns: Sequence[int], to: str, sep: str = "|") -> None:
    write_delimited(read_table(spark, path, columns, [f"c{k}" for k in columns], ["string"] * len(columns), sep), to, "\t")


def split_columns(df: DataFrame, directory: str) -> None:
    """One text folder for each column."""
    for c in df.columns:
        df.select(F.col(c).cast("string")).write.mode("overwrite").text(f"{directory}/{c}")
