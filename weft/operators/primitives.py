"""Data-parallel relational primitives: selection, scans, runs, reductions, histograms, sorting, sets, expansion.

Positions are explicit columns, since a DataFrame has no order of its own. Prefix scans run in two levels, over ranges
of the whole order key in parallel, so that no step sorts the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import held, ship

# --- selection ---------------------------------------------------------------------------------------------------


def select_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is true (or not 0), without the flag."""
    kept = F.col(flag) if dict(df.dtypes)[flag] == "boolean" else F.col(flag) != 0
    return df.filter(kept).drop(flag)


def select_if(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def partition_if(df: DataFrame, predicate: Column, position: str, to: str = "place") -> DataFrame:
    """Accepted rows first in their order, rejected ones behind them in reverse; the place from 0."""
    marked = df.withColumn("__ok", F.coalesce(predicate, F.lit(False)))
    key = F.when(F.col("__ok"), F.col(position)).otherwise(-F.col(position))
    return scan(marked, [(~F.col("__ok")).cast("int"), key], F.lit(1), to, inclusive=False).drop("__ok")


def bulk_remove(df: DataFrame, position: str, removed: DataFrame) -> DataFrame:
    """Rows whose position isn't listed, renumbered from 0."""
    kept = df.join(removed.select(F.col(removed.columns[0]).alias(position)), position, "left_anti")
    return scan(kept, [F.col(position)], F.lit(1), "__new", inclusive=False).withColumn(position, F.col("__new")).drop("__new")


def bulk_insert(df: DataFrame, position: str, inserted: DataFrame) -> DataFrame:
    """Inserted rows stand before the row that had their position; all are renumbered from 0."""
    both = df.withColumn("__side", F.lit(1)).unionByName(inserted.withColumn("__side", F.lit(0)))
    return scan(both, [F.col(position), F.col("__side")], F.lit(1), "__new", inclusive=False).withColumn(position, F.col("__new")).drop("__new", "__side")


# --- scans -------------------------------------------------------------------------------------------------------


def _running(op: str, inclusive: bool, kind: pa.DataType, names: list[str]):
    """For mapInArrow over sorted partitions whose last column is the value: that column becomes what the rows before it
    in the partition (and itself, if inclusive) make up; null where there are none."""
    fold = {"sum": pc.cumulative_sum_checked, "min": pc.cumulative_min, "max": pc.cumulative_max}[op]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = pa.scalar(None, kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = pa.array([carry.as_py()], kind)
            made = pc.fill_null_forward(fold(pa.concat_arrays([first, batch.column(batch.num_columns - 1).cast(kind)]), skip_nulls=True))
            carry = made[len(made) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made.slice(1 if inclusive else 0, batch.num_rows)], names=names)

    return run


def scan(df: DataFrame, order: Sequence[Column | str], value: Column | str, to: str, op: str = "sum", inclusive: bool = True) -> DataFrame:
    """Prefix sum, min or max of a numeric value in the order of unique keys. An exclusive scan's first row has 0 (sum)
    or NULL.

    Rows are dealt by ranges of the whole order key, as many as spark.sql.shuffle.partitions says, fewer for little
    data; each range is scanned by itself and written, once, to the shared folder; then it gets what all ranges before
    it make up, from a table of one row a range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    value = F.col(value) if isinstance(value, str) else value
    ship(df.sparkSession)
    names = [f"c{k}" for k in range(len(df.columns))]
    keys = [f"o{k}" for k in range(len(order))]
    marked = df.select("*", *[c.alias(f"__o{k}") for k, c in enumerate(order)], value.alias("__value")).toDF(*names, *keys, "value")
    kind = marked.schema["value"].dataType
    wide = T.LongType() if isinstance(kind, T.IntegralType) and op == "sum" else T.DoubleType() if isinstance(kind, T.FractionalType) else kind
    dealt = marked.withColumn("value", F.col("value").cast(wide)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*names, F.spark_partition_id().alias("range"), F.col("value").alias("own"), "value")
    out = [*names, "range", "own", "inner"]
    kinds = T.StructType([*[f for f in dealt.schema.fields if f.name != "value"], T.StructField("inner", wide)])
    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.ShortType(): pa.int16(), T.ByteType(): pa.int8()}[wide]
    done = held(dealt.mapInArrow(_running(op, inclusive, arrow, out), kinds), "scan")
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[op]
    totals = done.groupBy("range").agg(fold("own").alias("total"))
    earlier = totals.select("range", fold("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[op]
    met = done.join(F.broadcast(earlier), "range")  # one row a range
    return met.select(*names, join(F.col("before"), F.col("inner"))).toDF(*df.columns, to)


def segmented_scan(df: DataFrame, segment: str, order: str, value: str, to: str, op: str = "sum", inclusive: bool = True, backward: bool = False) -> DataFrame:
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[op]
    by = F.desc(order) if backward else F.asc(order)
    out = fold(value).over(Window.partitionBy(segment).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return df.withColumn(to, F.coalesce(out, F.lit(0)) if op == "sum" else out)


def change_flags(df: DataFrame, order: Sequence[str], value: str, to: str, segment: str | None = None) -> DataFrame:
    """Whether a row's value differs from the row before it; true for the first."""
    if segment is None:  # rows meet the ones before them by their places: no task orders the whole table
        placed = held(scan(df, order, F.lit(1), "__place", inclusive=False), "placed")
        before = placed.select((F.col("__place") + 1).alias("__place"), F.col(value).alias("__before"), F.lit(True).alias("__has"))
        return placed.join(before, "__place", "left").withColumn(to, F.col("__has").isNull() | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__place", "__before", "__has")
    w = Window.partitionBy(segment).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn(to, first | ~F.col(value).eqNullSafe(F.lag(value).over(w)))


def rank_in_group(df: DataFrame, parent: str, child: str, to: str = "rank") -> DataFrame:
    """Place of a child among its parent's, from 0."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(parent).orderBy(child)) - 1)


def list_rank(nodes: DataFrame, node: str = "node", nxt: str = "next", rounds: int = 64) -> DataFrame:
    """(node, distance to the end of its linked list) by pointer jumping: each round doubles the step. Lists that don't
    end within 2^rounds steps, as rings don't, are an error."""
    done = held(nodes.select(F.col(node).alias("node"), F.col(nxt).alias("next"), F.when(F.col(nxt).isNull(), 0).otherwise(1).cast("long").alias("rank")))
    n = done.count()
    for k in range(rounds):
        if done.filter("next is not null").isEmpty():
            return done.select("node", "rank")
        if 1 << k > max(n, 1) * 2:  # longer than all nodes in one list
            break
        # Never a broadcast: files of whole numbers are small, and each round would send the driver all nodes.
        other = done.select(F.col("node").alias("next"), F.col("next").alias("__to"), F.col("rank").alias("__more")).hint("merge")
        done = held(done.join(other, "next", "left").select("node", F.col("__to").alias("next"), (F.col("rank") + F.coalesce("__more", F.lit(0))).alias("rank")))
    raise ValueError("a list doesn't end: it is a ring, or longer than 2^rounds")


# --- runs and reductions -----------------------------------------------------------------------------------------


def runs(df: DataFrame, segment: str, order: str, value: str) -> DataFrame:
    """Run-length encoding in each segment: run (from 1), value, length, first and last place."""
    flagged = change_flags(df, [order], value, "__new", segment)
    numbered = flagged.withColumn("run", F.sum(F.col("__new").cast("int")).over(Window.partitionBy(segment).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(segment, "run").agg(F.first(value).alias(value), F.count("*").alias("length"), F.min(order).alias("first"), F.max(order).alias("last"))


def nontrivial_runs(df: DataFrame, segment: str, order: str, value: str) -> DataFrame:
    return runs(df, segment, order, value).filter("length > 1")


def reduce_by_key(df: DataFrame, keys: Sequence[str], value: str, op: str = "sum") -> DataFrame:
    return df.groupBy(*keys).agg(getattr(F, op)(value).alias(op))


def segmented_reduce(segments: DataFrame, values: DataFrame, segment: str, value: str, op: str = "sum", identity: float | int | None = 0) -> DataFrame:
    """One row for every segment; those without values have the identity. Values are reduced before the join."""
    reduced = values.groupBy(segment).agg(getattr(F, op)(value).alias(op))
    out = segments.select(segment).join(reduced, segment, "left")
    return out if identity is None else out.withColumn(op, F.coalesce(op, F.lit(identity)))


def arg_extremes(df: DataFrame, value: str, arg: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and largest value and the smallest arg that has each."""
    low = F.min(F.struct(F.col(value), F.col(arg)))
    high = F.max(F.struct(F.col(value), (-F.col(arg)).alias("a")))
    made = df.groupBy(*by).agg(low.alias("l"), high.alias("h"))
    return made.select(*by, F.col(f"l.{value}").alias("least"), F.col(f"l.{arg}").alias("arg_least"), F.col(f"h.{value}").alias("largest"), (-F.col("h.a")).alias("arg_largest"))


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, sum of v * x): matrix (i, j, v), vector (j, x)."""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def histogram_even(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count) for bins of equal width over [low, high); other values and NULLs are left out, empty bins are 0."""
    c = F.col(column).cast("double")
    at = F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    found = df.filter((c >= low) & (c < high)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    return _all_bins(df, found, bins)


def histogram_range(df: DataFrame, column: str, levels: Sequence[float]) -> DataFrame:
    """(bin, count) for bins between neighbouring levels, lower ends included."""
    c, at = F.col(column), F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(levels, levels[1:], strict=False)):
        at = F.when((c >= a) & (c < b), F.lit(k)).otherwise(at)
    found = df.select(at.alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("count"))
    return _all_bins(df, found, len(levels) - 1)


def multi_histogram_even(df: DataFrame, channels: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """(channel, bin, count), one histogram for each column and its range."""
    out = None
    for name, (low, high) in channels.items():
        made = histogram_even(df, name, low, high, bins).select(F.lit(name).alias("channel"), "bin", "count")
        out = made if out is None else out.unionByName(made)
    return out


def _all_bins(df: DataFrame, found: DataFrame, bins: int) -> DataFrame:
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def unique_consecutive(df: DataFrame, segment: str, order: str, value: str) -> DataFrame:
    """The first row of each run of equal values."""
    return change_flags(df, [order], value, "__new", segment).filter("__new").drop("__new")


# --- sorting -----------------------------------------------------------------------------------------------------


def sort_pairs(df: DataFrame, columns: Sequence[str], to: str | None = None) -> DataFrame:
    """Lexicographic order; with `to`, each row's place from 0 instead of an order of rows."""
    if to is None:
        return df.orderBy(*columns)
    return scan(df, [F.col(c) for c in columns], F.lit(1), to, inclusive=False)


def segmented_sort(df: DataFrame, segment: str, key: str, ties: Sequence[str] = (), descending: bool = False, to: str = "place") -> DataFrame:
    by = F.desc(key) if descending else F.asc(key)
    return df.withColumn(to, F.row_number().over(Window.partitionBy(segment).orderBy(by, *ties)) - 1)


def merge_sorted(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    return a.unionByName(b).orderBy(*columns)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The k first rows; each task keeps k of its own."""
    return df.orderBy(*order).limit(k)


# --- partitioning, search and expansion --------------------------------------------------------------------------


def radix_partition(df: DataFrame, key: str, bits: int, offset: int = 0, row: str | None = None, to: str = "bucket") -> DataFrame:
    """Bucket of each row by a radix digit, rows dealt out by bucket and sorted in it."""
    digit = F.shiftright(F.col(key), offset).bitwiseAND((1 << bits) - 1)
    return df.withColumn(to, digit.cast("int")).repartition(to).sortWithinPartitions(to, key, *([row] if row else []))


def bucket_offsets(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, count, start): sizes of radix buckets and where each begins; empty ones too."""
    digit = F.col(key).bitwiseAND((1 << bits) - 1).cast("int")
    counts = df.groupBy(digit.alias("bucket")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    before = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return filled.withColumn("start", F.coalesce(before, F.lit(0)))


def multisplit(df: DataFrame, bucket: Column, position: str, to: str = "place") -> DataFrame:
    """Stable order by bucket: each row's place from 0."""
    return scan(df.withColumn("__bucket", bucket), ["__bucket", position], F.lit(1), to, inclusive=False).drop("__bucket")


def expand(df: DataFrame, count: str, to: str = "rank") -> DataFrame:
    """`count` copies of each row, numbered from 0; none where it is 0 or less."""
    n = F.col(count).cast("int")
    return df.filter(n > 0).withColumn(to, F.explode(F.sequence(F.lit(0), n - 1)))


def interval_gather(intervals: DataFrame, source: DataFrame, start: str, count: str, position: str) -> DataFrame:
    """The source's rows at start, start + 1, ... of each interval, with their rank in it."""
    at = expand(intervals, count).withColumn(position, (F.col(start) + F.col("rank")).cast(source.schema[position].dataType))
    return at.join(source, position)


def scatter(values: DataFrame, position: str, n: int) -> DataFrame:
    """One row for each place below n, with the values put there or NULL. A position outside [0, n), or NULL, is an
    error when the result is computed."""
    inside = F.coalesce((F.col(position) >= 0) & (F.col(position) < n), F.lit(False))
    error = F.raise_error(F.concat(F.lit(f"{position} is outside [0, {n}): "), F.coalesce(F.col(position).cast("string"), F.lit("NULL"))))
    values = values.withColumn(position, F.when(inside, F.col(position)).otherwise(error.cast(values.schema[position].dataType)))
    every = values.sparkSession.range(n).select(F.col("id").cast(values.schema[position].dataType).alias(position))
    return every.join(values, position, "left")


def bounds(needles: DataFrame, haystack: DataFrame, key: str, upper: bool = False, to: str = "bound") -> DataFrame:
    """For each needle the number of haystack keys below it (upper: or equal), by one scan over both."""
    # Equal needles are one row with their number, so rows need no ids of their own.
    a = needles.groupBy(key).agg(F.count("*").alias("__times")).select(key, F.lit(0).cast("long").alias("__hay"), "__times")
    grouped = haystack.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__hay")).withColumn("__times", F.lit(None).cast("long"))
    side = F.when(F.col("__times").isNull(), 0 if upper else 1).otherwise(1 if upper else 0)
    both = a.unionByName(grouped.select(key, "__hay", "__times")).withColumn("__side", side)
    found = scan(both, [key, "__side"], "__hay", to, inclusive=False).filter("__times is not null")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(key, to)


def compact_ids(df: DataFrame, key: str, to: str = "dense") -> DataFrame:
    """(key, number) of each distinct key, dense from 0 in ascending order."""
    return scan(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], F.lit(1), to, inclusive=False)


def multivalue(df: DataFrame, key: str, value: str, to: str = "values") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(to))


# --- sets --------------------------------------------------------------------------------------------------------


def intersection(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of all inputs."""
    for b in others:
        a = a.intersect(b)
    return a.distinct() if not others else a


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less one for each equal row of b."""
    return a.exceptAll(b)


def concatenation(a: DataFrame, *others: DataFrame) -> DataFrame:
    for b in others:
        a = a.unionByName(b)
    return a


# --- texts -------------------------------------------------------------------------------------------------------


def suffix_array(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rank from 0, start from 0) of every suffix of each text."""
    n = F.length(text_col)
    suffixes = texts.filter(n > 0).withColumn("start", F.explode(F.sequence(F.lit(1), n))).withColumn("__suffix", F.expr(f"substring({text_col}, start)"))
    ranked = suffixes.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("__suffix")) - 1)
    return ranked.select(id_col, "rank", (F.col("start") - 1).alias("start"))


def burrows_wheeler(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bwt): characters before the suffixes in their order; the text ends with a sign below all others, chr(0)."""
    ended = texts.withColumn("__ended", F.concat(text_col, F.lit("\0")))
    ranks = suffix_array(ended, id_col, "__ended").join(ended.select(id_col, "__ended"), id_col)
    before = F.when(F.col("start") == 0, F.lit("\0")).otherwise(F.expr("substring(__ended, start, 1)"))
    lists = ranks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", before.alias("c")))).alias("x"))
    return lists.select(id_col, F.array_join(F.transform("x", lambda v: v["c"]), "").alias("bwt"))


def move_to_front(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, codes): places of characters in a list (at first, all of the text's in ascending order) that each moves to the front."""
    chars = F.filter(F.split(text_col, ""), lambda c: c != "")
    start = F.struct(F.array_sort(F.array_distinct(chars)).alias("held"), F.array().cast("array<int>").alias("codes"))

    def step(acc: Column, c: Column) -> Column:
        at = (F.array_position(acc["held"], c) - 1).cast("int")
        return F.struct(F.concat(F.array(c), F.array_remove(acc["held"], c)).alias("held"), F.concat(acc["codes"], F.array(at)).alias("codes"))

    return texts.select(id_col, F.aggregate(chars, start, step)["codes"].alias("codes"))


def tridiagonal_solve(systems: DataFrame, id_col: str, row: str, lower: str, diagonal: str, upper: str, right: str) -> DataFrame:
    """(id, row, x): each system's rows fit one task; solved by elimination and back substitution over sorted arrays."""
    lists = systems.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("i"), F.col(lower).cast("double").alias("a"), F.col(diagonal).cast("double").alias("b"), F.col(upper).cast("double").alias("c"), F.col(right).cast("double").alias("d")))).alias("rows"))
    kind = "array<struct<i:bigint,c:double,d:double>>"

    def forward(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        c0, d0 = F.coalesce(last["c"], F.lit(0.0)), F.coalesce(last["d"], F.lit(0.0))
        a = F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(r["a"])
        m = r["b"] - a * c0
        return F.concat(acc, F.array(F.struct(r["i"].cast("long").alias("i"), (r["c"] / m).alias("c"), ((r["d"] - a * d0) / m).alias("d"))))

    def backward(acc: Column, r: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["x"], F.lit(0.0))
        x = r["d"] - F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(r["c"]) * last
        return F.concat(acc, F.array(F.struct(r["i"].alias("i"), x.alias("x"))))

    swept = lists.select(id_col, F.aggregate("rows", F.array().cast(kind), forward).alias("swept"))
    solved = swept.select(id_col, F.explode(F.aggregate(F.reverse("swept"), F.array().cast("array<struct<i:bigint,x:double>>"), backward)).alias("__solved"))
    return solved.select(id_col, F.col("__solved.i").alias(row), F.col("__solved.x").alias("x"))
