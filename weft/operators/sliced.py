"""Joins in slices, for results or inputs that should pass in bounded portions; slices partition their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .natural_join import natural_join
from .wcoj import generic_join


def hash_slices(df: DataFrame, n: int, *by: str) -> Iterator[DataFrame]:
    """n disjoint slices that cover df; rows with equal `by` columns (all, if none) are in one."""
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in (by or df.columns)]), F.lit(n))
    return (df.filter(slot == k) for k in range(n))


def range_slices(df: DataFrame, column: str, n: int) -> Iterator[DataFrame]:
    """Disjoint ranges of a column's values, about equally full; NULLs are in the first."""
    return (df.filter(inside) for inside in ranges(df, column, n))


def ranges(df: DataFrame, column: str, n: int) -> Iterator[Column]:
    """Conditions on a column of this name, in any relation, that say which of range_slices a row is in."""
    bounds = sorted(set(df.approxQuantile(column, [k / n for k in range(1, n)], 0.01)))
    c = F.col(column)
    if not bounds:
        yield F.lit(True)
        return
    yield c.isNull() | (c < bounds[0])
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield (c >= a) & (c < b)
    yield c >= bounds[-1]


def sliced_join(relations: Sequence[DataFrame], n: int, each: Callable[[DataFrame], None] | None = None, **options) -> DataFrame | None:
    """natural_join, the first relation slice by slice. each: takes every slice's result, one after the other, and then
    nothing is returned; without it, the slices' union is."""
    out = None
    for part in hash_slices(relations[0], n):
        made = natural_join([part, *relations[1:]], **options)
        if each:
            each(made)
        else:
            out = made if out is None else out.unionByName(made)
    return out


def sliced_generic_join(relations: Sequence[DataFrame], order: Sequence[str], n: int, **options) -> DataFrame:
    """generic_join by value ranges of the first attribute: every relation that has it is cut to the range."""
    out = None
    root = next(r for r in relations if order[0] in r.columns)
    for inside in ranges(root.select(order[0]).distinct(), order[0], n):
        held = [r.filter(inside) if order[0] in r.columns else r for r in relations]
        made = generic_join(held, order, **options)
        out = made if out is None else out.unionByName(made)
    return out
