"""The random-projection trees of ann.py: built on a sample, searched through one priority queue."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Inner nodes of all trees in one array: normal, offset, children. A child below 0 is leaf -1 - child.

    A vector x goes right where normal . x > offset. Vectors have one more component than the data (see `lift`).
    """

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    n_leaves: int
    limit: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """sqrt(limit^2 - |x|^2) as one more component: all have the same length, so of lifted rows the nearest by angle
        to a query, whose own is 0, has the largest inner product with it."""
        rest = np.sqrt(np.maximum(self.limit**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Of lifted rows, the leaf in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                right = np.einsum("ij,ij->i", x[live], self.normals[node]) > self.offsets[node]
                at[live] = self.children[node, right.astype(np.int64)]
                live = live[at[live] >= 0]
            out[:, t] = -1 - at
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves for a query by one queue over all trees, nearest margins first, until they hold `enough` rows."""
        margins = (self.normals[:, :-1] @ query - self.offsets).tolist()  # of every node at once
        children = self.children.tolist()
        queue = [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            cost, at = heapq.heappop(queue)
            while at >= 0:  # the far side waits with the squares of all margins crossed on its way
                m = margins[at]
                near, far = children[at] if m <= 0 else children[at][::-1]
                heapq.heappush(queue, (cost + m * m, far))
                at = near
            if sizes[-1 - at]:
                found.append(-1 - at)
                held += sizes[-1 - at]
        return found


def build(sample: np.ndarray, n_trees: int, leaf: int, seed: int, limit: float) -> Forest:
    """Trees over the rows of a sample. A split lies halfway between two of a node's rows, drawn at random."""
    forest = Forest(np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), [], 0, limit)
    lifted = forest.lift(sample)
    rng = np.random.default_rng(seed)
    normals, offsets, children = [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = lifted[rng.choice(rows, 2, replace=False)]
                normal = a - b
                size = np.linalg.norm(normal)
                if size < 1e-9:
                    continue
                normal = normal / size
                offset = float(normal @ (a + b) / 2)
                right = lifted[rows] @ normal > offset
                if 0.05 * len(rows) <= right.sum() <= 0.95 * len(rows):
                    me = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[me] = [grow(rows[~right]), grow(rows[right])]
                    return me
        forest.n_leaves += 1
        return -forest.n_leaves

    forest.roots = [grow(np.arange(len(lifted))) for _ in range(n_trees)]
    width = lifted.shape[1]
    forest.normals = np.array(normals, np.float32).reshape(-1, width)
    forest.offsets, forest.children = np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2)
    return forest
