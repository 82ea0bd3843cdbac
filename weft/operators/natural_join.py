"""N-ary natural joins: bag semantics, NULL joins nothing, every attribute once in the result.

Steps are DataFrame joins in one plan. Broadcast steps chain without an exchange; a side is only broadcast if the
size that it takes in memory allows it, otherwise Catalyst and adaptive execution choose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hypergraph import attributes, connected, greedy_order, shared, size_in_bytes

HINTS = {"shuffle_hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}
#: Bytes in memory of all sides that one join broadcasts on request: the driver and each executor hold them.
BROADCAST_BYTES = 64 << 20
#: Bytes of a hash table's entry besides the row's values.
ENTRY_BYTES = 64


def bytes_in_memory(df: DataFrame) -> int:
    """What df's rows take as a hash table: rows are counted and values of varying length measured, as Catalyst's
    estimate is of compressed files, a small part of it."""
    fixed = [f for f in df.schema.fields if f.dataType.typeName() in ("boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz", "decimal")]
    varying = [f"`{f.name}`" for f in df.schema.fields if f not in fixed]
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in varying), F.lit(ENTRY_BYTES + 8 * len(fixed)))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]


def hinted(df: DataFrame, strategy: str) -> DataFrame:
    return df.hint(HINTS[strategy]) if strategy in HINTS else df


def natural_join(relations: Sequence[DataFrame], order: Sequence[int] | str | None = None, keys: str = "all", strategy: str = "auto", limit: int | None = None, allow_cross: bool = False) -> DataFrame:
    """Joins relations on all names that they share.

    order: positions, None for as given, or "greedy". keys="first" compares only the first attribute of each further
    relation; others that are bound already keep their first value. A disconnected join is an error unless
    allow_cross. The result has every attribute by first occurrence in `relations`; `limit` cuts it to so many rows.
    """
    if not relations:
        raise ValueError("no relations")
    steps = greedy_order(relations) if order == "greedy" else list(order) if order is not None else list(range(len(relations)))
    if sorted(steps) != list(range(len(relations))):
        raise ValueError("order must name every relation once")
    if not allow_cross and not connected(relations, steps):
        raise ValueError("the relations are not connected; allow_cross=True permits a cross product")
    out, room = relations[steps[0]], BROADCAST_BYTES
    for i in steps[1:]:
        right = relations[i]
        on = shared(out.columns, right.columns)
        if keys == "first" and on:
            if right.columns[0] not in on:
                raise ValueError(f"first attribute {right.columns[0]} isn't bound")
            right = right.drop(*[c for c in on if c != right.columns[0]])
            on = [right.columns[0]]
        if strategy == "broadcast" and on and size_in_bytes(right) <= room and (taken := bytes_in_memory(right)) <= room:
            right, room = F.broadcast(right), room - taken
        out = out.join(hinted(right, strategy), on) if on else out.crossJoin(right)
    names = [c for c in attributes(relations) if c in set(out.columns)]
    out = out.select(*names)
    return out if limit is None else out.limit(limit)


def join_count(relations: Sequence[DataFrame], **options) -> int:
    """Rows of the join."""
    return counted_join(relations, **options).first()["n"]


def counted_join(relations: Sequence[DataFrame], order: Sequence[int] | str | None = None, keys: str = "all", strategy: str = "auto", by: Sequence[str] = (), to: str = "n") -> DataFrame:
    """Rows of natural_join, by groups of attributes. Rows that agree in all that later steps and `by` compare are one
    row with their number, on both sides of each step, so their pairs are never made."""
    steps = greedy_order(relations) if order == "greedy" else list(order) if order is not None else list(range(len(relations)))
    if sorted(steps) != list(range(len(relations))):
        raise ValueError("order must name every relation once")
    if not connected(relations, steps):
        raise ValueError("the relations are not connected")
    held = [relations[i] for i in steps]
    if keys == "first":
        bound = set(held[0].columns)
        for k, r in enumerate(held[1:], 1):
            if r.columns[0] not in bound:
                raise ValueError(f"first attribute {r.columns[0]} isn't bound")
            held[k] = r.drop(*[c for c in r.columns[1:] if c in bound])
            bound |= set(r.columns)

    def numbered(df: DataFrame, kept: list[str], n: str, last: bool = False) -> DataFrame:
        if not last and len(kept) == len(set(df.columns) - {"__n"}):  # all of them: nothing to put together
            return df.select(*kept, (F.col("__n") if "__n" in df.columns else F.lit(1).cast("long")).alias(n))
        return df.groupBy(*kept).agg((F.sum("__n") if "__n" in df.columns else F.count("*")).alias(n))

    out = held[0]
    for k in range(1, len(held) + 1):
        asked = {*by, *(c for r in held[k:] for c in r.columns)}
        out = numbered(out, [c for c in out.columns if c in asked], "__n", k == len(held))
        if k == len(held):
            break
        on = shared(out.columns, held[k].columns)
        asked = {*on, *by, *(c for r in held[k + 1 :] for c in r.columns)}
        right = numbered(held[k], [c for c in held[k].columns if c in asked], "__m")
        out = out.join(hinted(right, strategy), on).withColumn("__n", F.col("__n") * F.col("__m")).drop("__m")
    return out.select(*by, F.coalesce("__n", F.lit(0)).cast("long").alias(to))


def pairwise_chain(relations: Sequence[DataFrame], checkpoint: bool = False) -> DataFrame:
    """Left-deep two-way joins, each on the next relation's first attribute."""
    out = relations[0]
    for right in relations[1:]:
        out = natural_join([out, right], keys="first", strategy="shuffle_hash")
        if checkpoint:
            out = out.checkpoint()
    return out


#: Rows of one key that meet as a cell: of the left side, of the right side.
CELL = (1 << 12, 1 << 13)


def row_id_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, strategy: str = "shuffle_hash") -> DataFrame:
    """Pairs of row ids with equal keys; the ids are columns of the inputs. A key's rows are dealt by their ids into cells
    of about CELL rows, and cells, not keys, into tasks: a key of many pairs is the work of many tasks, none of which
    holds more than its cells, and both sides' copies are some 1/2700 of the pairs."""
    a = left.select(F.col(key).alias("__k"), F.col(left_id).alias("left_row"))
    b = right.select(F.col(key).alias("__k"), F.col(right_id).alias("right_row"))
    cuts = [r.groupBy("__k").agg(F.ceil(F.count("*") / size).alias(to)) for r, size, to in ((a, CELL[0], "__p"), (b, CELL[1], "__q"))]
    cuts = cuts[0].join(cuts[1], "__k")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    a = a.join(cuts, "__k").select("left_row", "__k", place("left_row", "__p").alias("__i"), every("__q").alias("__j"))
    b = b.join(cuts, "__k").select("right_row", "__k", every("__p").alias("__i"), place("right_row", "__q").alias("__j"))
    on = ["__k", "__i", "__j"]
    n = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as adaptive execution sees the inputs' bytes, not the pairs
    return a.repartition(n, *on).join(hinted(b.repartition(n, *on), strategy), on).select("left_row", "right_row")


def lookup_join(left: DataFrame, table: DataFrame, key: str, assert_unique: bool = False) -> DataFrame:
    """Each row of left with the table's values for its key, NULL where the table has none. The table's keys must be
    unique; with assert_unique they are counted first, else a repeated key would multiply rows."""
    if assert_unique and (bad := table.groupBy(key).count().filter("count > 1").limit(1).collect()):
        raise ValueError(f"key {bad[0][key]} occurs {bad[0]['count']} times")
    return left.join(table, key, "left")


#: Bytes, as estimated of files, that one task of a distinct takes at most.
DISTINCT_BYTES = 4 << 20


def partitions_of(df: DataFrame) -> int:
    """So many that each has DISTINCT_BYTES at most, as Catalyst estimates."""
    return -(-size_in_bytes(df) // DISTINCT_BYTES)


def spread_distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, in as many partitions as the input's size asks for: adaptive execution would put together what
    comes to 64 MB compressed, which is some ten million rows of two numbers and gigabytes as a hash table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_of(df))
    return df.repartition(n, *[F.col(f"`{c}`") for c in df.columns]).distinct()


def semi_reduce(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows that can't join."""
    on = list(on)
    return left.join(right.select(*on).distinct(), on, "left_semi"), right.join(left.select(*on).distinct(), on, "left_semi")


def estimated_rows(probe: DataFrame, build: Sequence[DataFrame], fraction: float = 0.01, seed: int = 1) -> float:
    """Estimate of a join's rows: a sample of the probe side joined with whole build sides."""
    n = natural_join([probe.sample(fraction, seed), *build]).count()
    return n / fraction
