"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

Pass 1 scatters whole records into buckets by a seeded hash. The number of buckets follows from the table's bytes, so
that one holds about `bucket_bytes`, at any size of the table. Pass 2 puts each bucket into the order of a second
seeded hash, by a sort that can spill, and writes it. Buckets one after the other are then a uniform permutation of all
records, and shards are equal runs of it: counts differ by one at most (the law `rows`), and a bucket's records lie in
few shards, so pass 2 writes few files.

An order by independent hashes has the distribution of a Fisher-Yates shuffle. Spark's shuffle(), which is one, takes
its random numbers by the task that it runs in: the same bucket would come out differently under another partitioning,
or in a task that is run again; so it isn't used.

The hashes take all columns of a record (maps as lists of their entries) and, of equal records, a number from 0: equal
records are reduced to one row with their count in every task before they are shuffled, and made again behind it. So
the result depends on the records and the seed alone, whatever the input's partitions are, and a third of all records
that are equal spread like others. A bucket's size is binomial around its mean; nothing is capped.

Defined results: a null text has no bytes and checksum 0; null ids are records like others; repeated rows each get
their own slot; an empty table gives empty shards; input columns named as a result column come back as <name>_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, hold, inner, outer_names, scratch, table

#: Bytes of records in a bucket, and shards of the registered query.
BUCKET_BYTES, SHARDS = 16 << 20, 24
#: Tasks that order buckets, at most; with more buckets, a task orders several, by one sort that spills.
MOST_TASKS = 100_000
#: Rows up to which offsets of buckets, or hashes of repeated records, are broadcast (16 bytes each); beyond, a shuffle.
BROADCAST_ROWS = 100_000


def size_of(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def comparable(c: Column, kind: T.DataType) -> Column:
    """The value with maps as arrays of their entries, so that it can be hashed."""
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(c, lambda e: comparable(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.struct(c.isNull().alias("none"), *[comparable(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
    return c


def _has_map(kind: T.DataType) -> bool:
    inside = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, inside))


def few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def numbered(records: DataFrame, own: list[str], seed: int) -> DataFrame:
    """All records with h1 and h2, hashes of what a record is, and number: of equal records, from 0."""
    flat = [comparable(F.col(f.name), f.dataType) for f in records.schema.fields]
    hashed = records.select(*own, F.xxhash64(F.lit(seed), *flat).alias("h1"), F.xxhash64(F.lit(seed + 1), *flat).alias("h2"))
    again = hold(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"), "repeats")
    n = again.count()
    if not n:
        return hashed.withColumn("number", F.lit(0))
    once = hashed.join(few(again, n), ["h1", "h2"], "left_anti").withColumn("number", F.lit(0))
    equal = hashed.join(few(again, n), ["h1", "h2"], "left_semi").groupBy(*own, "h1", "h2").agg(F.count("*").cast("int").alias("n"))
    return once.unionByName(equal.select(*own, "h1", "h2", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("number")))


def assign(docs: DataFrame, n_shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """All columns of docs, shard (from 0) and slot (gapless from 0 in each shard), by the law `rows`."""
    total = docs.select(col(text_col).alias("text")).agg(F.sum(size_of("text")).alias("n")).first()["n"] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    records = inner(docs, docs.columns)
    own = records.columns
    keyed = numbered(records, own, seed)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "number"), F.lit(n_buckets))
    scattered = keyed.select(*own, "h1", "h2", "number", bucket.alias("bucket"), F.xxhash64(F.lit(seed + 2), "h1", "h2", "number").alias("at"))
    counts = hold(scattered.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    everything = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    mixed = Window.partitionBy("bucket").orderBy("at", "h1", "h2", "number")
    placed = scattered.repartition(min(n_buckets, MOST_TASKS), "bucket").withColumn("place", F.row_number().over(mixed) - 1).join(few(offsets, n_buckets), "bucket")
    at = F.col("before") + F.col("place")
    each, more = everything // n_shards, everything % n_shards
    long_run = more * (each + 1)  # the first shards have one record more
    early, rest = at < long_run, max(each, 1)
    shard = F.when(early, F.floor(at / (each + 1))).otherwise(more + F.floor((at - long_run) / rest))
    slot = F.when(early, at % (each + 1)).otherwise((at - long_run) % rest)
    new = ["shard", "slot"]
    return placed.select(*own, shard.cast("int"), slot.cast("long")).toDF(*outer_names(docs.columns, new), *new)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> str:
    """Writes path/shard=K/ with each shard's records; sorted by slot within a file, they read in order."""
    path = path or scratch(docs.sparkSession, "sharded")
    assign(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return placed.select("doc_id", size_of("text").alias("size"), checksum.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
