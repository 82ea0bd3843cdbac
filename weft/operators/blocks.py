"""Two-step paths a0 -> a1 -> a2 by blocks: edges of neighbouring first vertices, with the lists of their middle ones.

A block gets the list of a middle vertex once, however many of its edges lead there, and its paths are made in numpy, so
neither paths nor copies of lists are shuffled. Blocks whose paths are many are dealt into parts by the last vertex.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import held, ship
from .natural_join import partitions_of

#: Edges that end a block (all edges of a vertex are in one); paths of a part; paths made at once.
EDGES, PATHS, AT_ONCE = 1 << 18, 1 << 24, 1 << 20


def integral(*relations: DataFrame) -> bool:
    return all(isinstance(f.dataType, T.IntegralType) for r in relations for f in r.schema.fields)


def _numbered(size: int):
    """For mapInArrow over partitions sorted by the first column: that a block ends where it changes, after `size` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            if a[0] == last:
                new = new[1:]
            out, at = np.empty(len(a), np.int64), 0
            while (k := np.searchsorted(new, max(at, at + size - rows))) < len(new):
                out[at : new[k]] = block
                block, rows, at, new = block + 1, 0, int(new[k]), new[k + 1 :]
            out[at:] = block
            rows, last = rows + len(a) - at, a[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["a0", "a1", "of", "block"])

    return run


class Paths:
    """Edges and lists of one part of a block. of: bits 1 for first edges, 2 for edges that may close a path."""

    def __init__(self, left: pa.Table, right: pa.Table):
        a0, a1, of = (left.column(c).to_numpy() for c in ("a0", "a1", "of"))
        near = right.column("near").combine_chunks()
        near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
        width, values = near.value_lengths().to_numpy().astype(np.int64), near.flatten().to_numpy()
        self.roots, at0 = np.unique(a0, return_inverse=True)
        self.middles, middle = np.unique(np.repeat(right.column("middle").to_numpy(), width), return_inverse=True)
        order = np.argsort(middle, kind="stable")
        self.values, self.at2 = np.unique(values[order], return_inverse=True)
        start = np.append(0, np.cumsum(np.bincount(middle, minlength=len(self.middles))))
        first = np.flatnonzero(of & 1)
        first = first[np.isin(a1[first], self.middles)]
        first = first[np.argsort(at0[first], kind="stable")]
        place = np.searchsorted(self.middles, a1[first])
        self.root, self.a1, self.start, self.width = at0[first], a1[first], start[place], start[place + 1] - start[place]
        closing = np.flatnonzero(of & 2)
        closing = closing[np.isin(a1[closing], self.values)]
        self.closing = np.sort(at0[closing] * len(self.values) + np.searchsorted(self.values, a1[closing]))

    def spans(self, whole: bool) -> Iterator[tuple[int, int]]:
        """Runs of edges with at most AT_ONCE paths, or of one edge; whole: of all edges of some roots."""
        last = np.append(self.root[1:] != self.root[:-1], True)[: len(self.root)]
        stops = np.flatnonzero(last) + 1 if whole else np.arange(1, len(self.root) + 1)
        ends = np.cumsum(self.width)[stops - 1]
        k = at = done = 0
        while k < len(stops):
            k = max(k + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            yield at, int(stops[k - 1])
            at, done = int(stops[k - 1]), int(ends[k - 1])

    def codes(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each path of edges a to b: its edge, and root and last vertex as one number."""
        width = self.width[a:b]
        edge = np.repeat(np.arange(a, b), width)
        at = np.arange(len(edge)) + np.repeat(self.start[a:b] - (np.cumsum(width) - width), width)
        return edge, self.root[edge] * len(self.values) + self.at2[at]


def closed(paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places among the first ones) and last vertices of paths whose ends are linked."""
    n = len(paths.roots) * len(paths.values)
    marks = None
    if n <= 1 << 26:
        marks = np.zeros(n, bool)
        marks[paths.closing] = True
    edges, lasts = [np.zeros(0, int)], [np.zeros(0, int)]
    for a, b in paths.spans(False):
        edge, code = paths.codes(a, b)
        if marks is None:
            at = np.searchsorted(paths.closing, code)
            kept = np.flatnonzero(np.append(paths.closing, -1)[at] == code)
        else:
            kept = np.flatnonzero(marks[code])
        edges.append(edge[kept])
        lasts.append(code[kept] % max(len(paths.values), 1))
    return np.concatenate(edges), paths.values[np.concatenate(lasts)]


def powers(paths: Paths, power: int) -> int:
    """Sum over pairs of ends of the number of paths between them, to a power."""
    total, n = 0, len(paths.values)
    for a, b in paths.spans(True):
        code = paths.codes(a, b)[1]
        low, high = int(paths.root[a]) * n, (int(paths.root[b - 1]) + 1) * n
        ways = np.bincount(code - low) if high - low <= 8 * len(code) else np.unique(code, return_counts=True)[1]
        total += sum(int(k) ** power * int(c) for k, c in enumerate(np.bincount(ways)) if c)
    return total


def dealt(rows: DataFrame) -> DataFrame:
    """Ranges of a0, ordered. Of large tables as many as their size asks for, not as many as partitions of a shuffle (16
    times these at most, as the estimate of a join's size is a product)."""
    n, usual = partitions_of(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange("a0") if n <= usual else rows.repartitionByRange(min(n, 16 * usual), "a0")
    return ranges.sortWithinPartitions("a0")


def over_paths(first: DataFrame, second: DataFrame, closing: DataFrame | None, kernel: Callable[[Paths], dict], schema: str, chunk: int | None = None) -> DataFrame:
    """What `kernel` makes of each part of a block. Relations are distinct, without nulls, of whole numbers: first
    (a0, a1), second (a1, a2), closing (a0, a2). chunk: entries that one row of lists has at most."""
    spark = ship(first.sparkSession)
    plain = lambda r: r.select(*[F.col(c).cast("long") for c in r.columns])
    first, second, closing = plain(first), plain(second), None if closing is None else plain(closing)
    same = lambda r: r is not None and r.toDF("a0", "a1").sameSemantics(first.toDF("a0", "a1"))
    rows = first.toDF("a0", "a1").withColumn("of", F.lit(3 if same(closing) else 1))
    if closing is not None and not same(closing):
        rows = rows.unionByName(closing.toDF("a0", "a1").withColumn("of", F.lit(2)))
    edges = held(dealt(rows).mapInArrow(_numbered(EDGES), "a0 long, a1 long, of int, block long"), "blocks")
    if same(second):  # made once
        second = edges.filter("of & 1 = 1").select("a0", "a1")
    second = second.toDF("a1", "a2")
    needed = edges.filter("of & 1 = 1").groupBy("block", "a1").agg(F.count("*").alias("n"))
    degrees = second.groupBy("a1").agg(F.count("*").alias("degree"))
    sizes = needed.join(degrees, "a1").groupBy("block").agg(F.sum(F.col("n") * F.col("degree")).alias("paths"))
    many = sizes.select("block", F.ceil(F.col("paths") / PATHS).alias("parts"))
    many = {r["block"]: r["parts"] for r in many.filter("parts > 1").collect()}  # one row a block
    if chunk is None:
        lists = second.groupBy("a1").agg(F.collect_list("a2").alias("near"))
    else:
        piece = F.pmod(F.xxhash64("a2"), F.ceil(F.col("degree") / chunk))
        lists = second.join(degrees, "a1").groupBy("a1", piece.alias("piece")).agg(F.collect_list("a2").alias("near")).drop("piece")
    right = needed.select("block", "a1").join(lists, "a1")
    none = F.lit(0).cast("long")
    left, right = edges.withColumn("part", none), right.withColumn("part", none)
    if many:
        parts = F.broadcast(spark.createDataFrame(list(many.items()), "block long, parts long"))
        every = F.explode(F.sequence(none, F.coalesce("parts", F.lit(1).cast("long")) - 1))
        left = left.join(parts, "block", "left").withColumn("part", every).drop("parts")
        right = right.join(parts, "block", "left").withColumn("part", every)
        inside = F.filter("near", lambda v: F.pmod(F.xxhash64(v), F.coalesce("parts", F.lit(1).cast("long"))) == F.col("part"))
        right = right.withColumn("near", inside).drop("parts")
    kinds = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[f.dataType.simpleString()]) for f in kinds.fields])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table(kernel(Paths(a, b)), arrow) if a.num_rows and b.num_rows else arrow.empty_table()

    by = ["block", "part"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Columns of other names: both sides come from one table.
    left = left.select("block", "part", "a0", "a1", "of").repartition(n, *by)
    right = right.select(F.col("block").alias("to_block"), F.col("part").alias("to_part"), F.col("a1").alias("middle"), "near").repartition(n, "to_block", "to_part")
    return left.groupBy(*by).cogroup(right.groupBy("to_block", "to_part")).applyInArrow(run, kinds)


def closed_paths(first: DataFrame, second: DataFrame, closing: DataFrame, chunk: int | None = None) -> DataFrame:
    """(a0, a1, found): the last vertices of first (a0, a1) and second (a1, a2) that closing (a0, a2) has; edges without
    any are left out. A pair may have several rows."""

    def kernel(paths: Paths) -> dict:
        edge, last = closed(paths)
        used, width = np.unique(edge, return_counts=True)  # edges come in ascending order
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), pa.array(last, pa.int64()))
        return {"a0": paths.roots[paths.root[used]], "a1": paths.a1[used], "found": found}

    return over_paths(first, second, closing, kernel, "a0 long, a1 long, found array<long>", chunk)


def parallel_path_count(edges: DataFrame, times: int) -> DataFrame:
    """One row, `count`: ways to choose `times` paths of two edges, in order and with repetition, with the same ends."""
    edges = edges.toDF("a0", "a1")
    made = over_paths(edges, edges, None, lambda paths: {"n": [powers(paths, times)]}, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"))
