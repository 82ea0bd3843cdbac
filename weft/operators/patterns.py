"""Subgraph patterns over a directed edge list: homomorphisms by default, as joins of the edges with themselves."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import integral, parallel_path_count
from .natural_join import counted_join, natural_join
from .wcoj import generic_join

Pattern = Sequence[tuple[int, int]]

TRIANGLE: Pattern = ((0, 1), (1, 2), (0, 2))
FOUR_CLIQUE: Pattern = ((0, 1), (1, 2), (2, 3), (0, 3), (0, 2), (1, 3))
WEDGE: Pattern = ((0, 1), (1, 2))
PATH_3: Pattern = ((0, 1), (1, 2), (2, 3))
SQUARE: Pattern = ((0, 1), (1, 2), (3, 2), (0, 3))
DIAMOND: Pattern = ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3))
TAILED_TRIANGLE: Pattern = ((0, 1), (1, 2), (0, 2), (2, 3))


def star(n: int) -> Pattern:
    return tuple((0, k) for k in range(1, n + 1))


def clique(n: int) -> Pattern:
    return tuple((i, j) for i in range(n) for j in range(i + 1, n))


def edge_relations(edges: DataFrame, pattern: Pattern, assume_distinct: bool = False, drop_self_loops: bool = False) -> list[DataFrame]:
    """One relation a{i}, a{j} for each edge of the pattern. edges: two columns, source and destination."""
    held = edges.toDF("src", "dst").dropna()
    if drop_self_loops:
        held = held.filter("src <> dst")
    if not assume_distinct:
        held = held.dropDuplicates()
    return [held.select(F.col("src").alias(f"a{i}"), F.col("dst").alias(f"a{j}")) for i, j in pattern]


def match(edges: DataFrame, pattern: Pattern = TRIANGLE, strategy: str = "auto", isomorphism: bool = False, assume_distinct: bool = False, drop_self_loops: bool = False, keys: str = "all", **options) -> DataFrame:
    """All bindings a0, a1, ... of the pattern. strategy: "wcoj" for attribute-at-a-time expansion, also what
    "auto" means for triangles of whole numbers; else that of natural_join. isomorphism: different attributes have different vertices."""
    relations = edge_relations(edges, pattern, assume_distinct, drop_self_loops)
    n = 1 + max(max(p) for p in pattern)
    if strategy == "wcoj" or (strategy == "auto" and keys == "all" and not options and tuple(pattern) == TRIANGLE and integral(*relations)):
        out = generic_join(relations, [f"a{k}" for k in range(n)] if _prefix_linked(pattern) else None, assume_distinct=True, **options)
    else:
        out = natural_join(relations, keys=keys, strategy=strategy, **options)
    out = out.select(*[f"a{k}" for k in range(n)])
    if isomorphism:
        for i in range(n):
            for j in range(i):
                out = out.filter(F.col(f"a{i}") != F.col(f"a{j}"))
    return out


def count_matches(edges: DataFrame, pattern: Pattern = TRIANGLE, by: Sequence[str] = (), **options) -> DataFrame:
    """Number of bindings, by groups of attributes; the last attribute of the order is never expanded. Parallel paths of
    two edges, as a square's, are counted by their ends: n paths make n^2 squares. Trees are counted vertex by vertex."""
    relations = edge_relations(edges, pattern, options.pop("assume_distinct", False), options.pop("drop_self_loops", False))
    n = 1 + max(max(p) for p in pattern)
    if not by and (times := _parallel(pattern)) and not set(options) - {"order"} and integral(relations[0]):
        return parallel_path_count(relations[0], times)
    if not options and not _cyclic(pattern):
        return counted_join(relations, by=by, to="count")
    order = options.pop("order", [f"a{k}" for k in range(n)] if _prefix_linked(pattern) else None)
    return generic_join(relations, order, list(by), assume_distinct=True, **options)


def _cyclic(pattern: Pattern) -> bool:
    """Whether a linked pattern has more edges than a tree."""
    return len(pattern) >= len({v for p in pattern for v in p})


def _parallel(pattern: Pattern) -> int:
    """How many paths start -> middle -> end, with the same ends, the pattern is made of; 0 if it is another one."""
    starts, ends = {a for a, _ in pattern} - {b for _, b in pattern}, {b for _, b in pattern} - {a for a, _ in pattern}
    middles = {v for p in pattern for v in p} - starts - ends
    paths = {(a, m) for a in starts for m in middles} | {(m, b) for m in middles for b in ends}
    return len(middles) if len(starts) == len(ends) == 1 and set(pattern) == paths and len(pattern) == len(paths) else 0


def _prefix_linked(pattern: Pattern) -> bool:
    n = 1 + max(max(p) for p in pattern)
    return all(any(max(p) == k and min(p) < k for p in pattern) for k in range(1, n))


def degrees(edges: DataFrame) -> DataFrame:
    held = edges.toDF("src", "dst")
    return held.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def bfs_levels(edges: DataFrame, source: int, max_depth: int | None = None) -> DataFrame:
    """(v, level) of all vertices that the source reaches, in at most max_depth steps if that is given. Each level is
    checkpointed, and every 16th all that was seen, so that plans don't grow; the loop ends with an empty frontier."""
    held = edges.toDF("src", "dst").dropna().distinct()
    kind = held.schema["src"].dataType
    frontier = held.sparkSession.range(1).select(F.lit(source).cast(kind).alias("v"), F.lit(0).alias("level"))
    seen = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = held.join(frontier.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v")).distinct()
        frontier = written(reached.join(seen, "v", "left_anti").withColumn("level", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = written(seen)
    return seen


def written(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the folder that spark.checkpoint.dir names."""
    from ..sources.shared import checkpointed

    return checkpointed(df)
