"""A natural join as a hypergraph: relations are edges over attributes, a shared name is a join condition."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import DataFrame


def shared(bound: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Attributes of a relation that are bound already, in the relation's order."""
    have = set(bound)
    return [c for c in columns if c in have]


def attributes(relations: Sequence[DataFrame]) -> list[str]:
    """Every attribute once, by first occurrence."""
    return list(dict.fromkeys(c for r in relations for c in r.columns))


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, from file sizes and statistics; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def greedy_order(relations: Sequence[DataFrame], sizes: Sequence[int] | None = None) -> list[int]:
    """The largest relation first, as it streams past the others; then always the linked one that multiplies rows least,
    so that no step is a cross product unless the join itself is disconnected. An attribute has at most as many values
    as the smallest relation with it has rows; a relation's size over the product of those is its estimated fan-out."""
    sizes = list(sizes) if sizes is not None else [size_in_bytes(r) for r in relations]
    left = list(range(len(relations)))
    first = max(left, key=lambda i: (sizes[i], -i))
    order, bound = [first], set(relations[first].columns)
    left.remove(first)
    values = {a: max(1, min(n for r, n in zip(relations, sizes, strict=True) if a in r.columns)) for a in attributes(relations)}

    def fan_out(i: int) -> float:
        return sizes[i] / prod(values[a] for a in bound & set(relations[i].columns))

    while left:
        linked = [i for i in left if bound & set(relations[i].columns)]
        nxt = min(linked or left, key=lambda i: (fan_out(i) if linked else 0, sizes[i], i))
        order.append(nxt)
        left.remove(nxt)
        bound |= set(relations[nxt].columns)
    return order


def connected(relations: Sequence[DataFrame], order: Sequence[int]) -> bool:
    bound = set(relations[order[0]].columns)
    for i in order[1:]:
        if not bound & set(relations[i].columns):
            return False
        bound |= set(relations[i].columns)
    return True
