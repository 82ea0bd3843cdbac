"""Worst-case-optimal joins of binary relations, one attribute at a time.

A binding is extended by an attribute's candidates: the intersection of the adjacency arrays of all relations that
link it to bound attributes. No intermediate result exceeds the bindings of a prefix of attributes. Relations are
sets: duplicates are dropped unless the caller vouches for them. The last attribute needn't be bound for a count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.hypergraph import attributes
from .blocks import closed_paths, integral


def adjacency(edges: DataFrame, src: str, dst: str, to: str = "near", parts: int = 1) -> DataFrame:
    """(src, array of distinct dst, ascending). With `parts`, also `part`, the hash of dst: a hub's list is several rows,
    gathered by themselves; lists of different edges have equal vertices in equal parts."""
    if parts == 1:
        return edges.groupBy(src).agg(F.array_sort(F.collect_set(dst)).alias(to))
    part = F.pmod(F.xxhash64(dst), F.lit(parts)).cast("int")
    return edges.groupBy(src, part.alias("part")).agg(F.array_sort(F.collect_set(dst)).alias(to))


def parts_of(links: Sequence[tuple[DataFrame, str]], attr: str, chunk: int | None) -> int:
    """Parts of adjacency lists so that the longest one has about `chunk` entries in each."""
    if chunk is None:
        return 1
    degrees = (r.groupBy(other).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0 for r, other in links)
    return max(1, -(-max(degrees) // chunk))


def nested_adjacency(rows: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """Three levels: (first, array of (second, array of third)), all ascending and distinct."""
    inner = rows.groupBy(first, second).agg(F.array_sort(F.collect_set(third)).alias("below"))
    return inner.groupBy(first).agg(F.array_sort(F.collect_list(F.struct(F.col(second).alias("value"), "below"))).alias("near"))


def intersect_all(arrays: Sequence[Column]) -> Column:
    return reduce(F.array_intersect, arrays)


def attribute_order(relations: Sequence[DataFrame]) -> list[str]:
    """Attributes of many relations first, each next one linked to those before if it can be."""
    names = attributes(relations)
    degree = {a: sum(a in r.columns for r in relations) for a in names}
    order: list[str] = []
    while len(order) < len(names):
        rest = [a for a in names if a not in order]
        links = {a: sum(a in r.columns and any(b in order for b in r.columns) for r in relations) for a in rest}
        order.append(min(rest, key=lambda a: (-links[a], -degree[a], names.index(a))))
    return order


def _bound_by(relations: Sequence[DataFrame], bound: Sequence[str], attr: str) -> list[tuple[DataFrame, str]]:
    out = []
    for r in relations:
        if attr in r.columns:
            other = next(c for c in r.columns if c != attr)
            if other in bound:
                out.append((r, other))
    return out


def generic_join(relations: Sequence[DataFrame], order: Sequence[str] | None = None, count_by: Sequence[str] | None = None, chunk: int | None = None, assume_distinct: bool = False) -> DataFrame:
    """Natural join of two-column relations.

    Without count_by: all attributes of the result, in the order in which the relations name them. With count_by (a
    list of attributes but the last one of the order, maybe empty): their groups and `count`, summed from sizes of
    the last intersections, which are never expanded. chunk: about how many entries an adjacency row may have; lists are
    then gathered, joined and intersected in so many parts by hash of the new vertex that a hub's have no more. Triangles
    of whole numbers, at the order's begin, are closed by blocks (blocks.py).
    """
    if any(len(r.columns) != 2 for r in relations):
        raise ValueError("relations must have two columns")
    if not assume_distinct:
        relations = [r.dropna().distinct() for r in relations]
    names = attributes(relations)
    order = list(order) if order is not None else attribute_order(relations)
    first = [r for r in relations if order[0] in r.columns and order[1] in r.columns]
    if not first:
        raise ValueError("the first two attributes of the order share no relation")
    out = first[0].select(*order[:2])
    for r in first[1:]:
        out = out.join(r, order[:2], "left_semi")
    for k, attr in enumerate(order[2:], 2):
        links = _bound_by(relations, order[:k], attr)
        if not links:
            raise ValueError(f"{attr} is not linked to earlier attributes")
        if k == 2 and [other for _, other in sorted(links, key=lambda x: order.index(x[1]))] == order[:2] and len(links) == 2 and integral(*relations):
            third, second = (r.select(other, attr) for r, other in sorted(links, key=lambda x: order.index(x[1])))
            kinds = {f.name: f.dataType for r in relations for f in r.schema.fields}
            made = closed_paths(out, second, third, chunk).toDF(order[0], order[1], "__found")
            made = made.select(*[F.col(c).cast(kinds[c]).alias(c) for c in order[:2]], "__found")
            if count_by is not None and k == len(order) - 1:
                return made.select(*count_by, F.size("__found").alias("__n")).groupBy(*count_by).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("count"))
            out = made.select(*order[:2], F.explode(F.col("__found").cast(T.ArrayType(kinds[attr]))).alias(attr))
            continue
        near, parts = [], parts_of(links, attr, chunk)
        for i, (r, other) in enumerate(links):
            rows = adjacency(r, other, attr, f"__near{i}", parts)
            out = out.join(rows, [other] if parts == 1 or not i else [other, "part"])
            near.append(F.col(f"__near{i}"))
        found = intersect_all(near)
        if count_by is not None and k == len(order) - 1:
            return out.select(*count_by, F.size(found).alias("__n")).groupBy(*count_by).agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("count"))
        out = out.select(*order[:k], F.explode(found).alias(attr))
    if count_by is not None:
        return out.groupBy(*count_by).agg(F.count("*").alias("count"))
    return out.select(*names)


def triangle_levels(r: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """Triangles R(a0,a1), S(a1,a2), T(a0,a2) level by level: roots in both R and T; their children in R that are
    roots of S; then the common children of S's and T's nodes."""
    roots = r.select("a0").distinct().join(t.select("a0").distinct(), "a0", "left_semi")
    pairs = r.distinct().join(roots, "a0", "left_semi").join(s.select("a1").distinct(), "a1", "left_semi")
    below_s, below_t = adjacency(s, "a1", "a2", "of_s"), adjacency(t, "a0", "a2", "of_t")
    return pairs.join(below_s, "a1").join(below_t, "a0").select("a0", "a1", F.explode(F.array_intersect("of_s", "of_t")).alias("a2"))
