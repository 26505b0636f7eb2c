"""Forests as node arrays, and their walk over whole Arrow batches of places.

All trees of a block step down one level at a time for all places of a batch, as numpy
gathers, so the work of Python goes by levels and not by places.  The arrays travel
in broadcasts of at most BLOCK_NODES nodes (14 bytes each), never in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes of a broadcast; a forest of more goes in several, each with whole trees.
BLOCK_NODES = 1 << 22
#: Pairs of a tree and a place that step together.
PAIRS = 1 << 20


@dataclass(frozen=True, eq=False)
class Trees:
    """Per node: feature (-1: leaf), number (threshold, or a leaf's probability of label 1) and left child; the right child is the one after it.

    A value of at most the threshold goes left.  This is all that scoring needs, so it
    also stands for models of other makers: whatever can be written as trees scores
    like a trained forest.
    """

    roots: np.ndarray
    feature: np.ndarray
    number: np.ndarray
    left: np.ndarray

    def __len__(self) -> int:
        return len(self.roots)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sums over the trees of their leaves' probabilities, for rows of features."""
        total = np.zeros(len(x))
        step = max(1, PAIRS // max(len(self), 1))
        for at in range(0, len(x), step):
            total[at : at + step] = self._walked(x[at : at + step])
        return total

    def _walked(self, x: np.ndarray) -> np.ndarray:
        total, leaves = np.zeros(len(x)), self.number[self._ends(x)].reshape(len(self), len(x))
        for leaf in leaves:  # in the order of the trees, so that sums are the same everywhere
            total += leaf
        return total

    def _ends(self, x: np.ndarray) -> np.ndarray:
        """The leaves of all rows in the first tree, then in the second, and so on."""
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        node = np.repeat(self.roots, len(x))
        start = np.tile(np.arange(len(x), dtype=np.int64) * width, len(self))
        live = np.flatnonzero(self.feature[node] >= 0)
        while len(live):
            # pairs that have reached a leaf stay there; the others go on in fewer steps
            at, base = node[live], start[live]
            for _ in range(4):
                f = self.feature[at]
                inner = f >= 0
                below = self.left[at] + (flat[base + np.maximum(f, 0)] > self.number[at])
                at = np.where(inner, below, at)
            node[live] = at
            live = live[self.feature[at] >= 0]
        return node

    def blocks(self) -> list[Trees]:
        """The forest as forests of at most BLOCK_NODES nodes, or of one tree."""
        ends, made, first = [*self.roots[1:].tolist(), len(self.feature)], [], 0
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or ends[i + 1] - self.roots[first] > BLOCK_NODES:
                a = int(self.roots[first])
                made.append(Trees(self.roots[first : i + 1] - a, self.feature[a:end], self.number[a:end], np.maximum(self.left[a:end] - a, 0)))
                first = i + 1
        return made

    def renumbered(self, index: Sequence[int] | None) -> Trees:
        """With the features that index gives for their numbers."""
        if index is None:
            return self
        return Trees(self.roots, np.where(self.feature < 0, -1, np.asarray(index, dtype=np.int16)[np.maximum(self.feature, 0)]), self.number, self.left)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node of the only tree in which each row of features ends."""
        return self._ends(x)

    def table(self, spark: SparkSession) -> DataFrame:
        """The nodes as rows (node, root, feature, number, left)."""
        n = len(self.feature)
        columns = {"node": np.arange(n), "root": np.isin(np.arange(n), self.roots), "feature": self.feature, "number": self.number, "left": self.left}
        return spark.createDataFrame(pa.table(columns))

    @classmethod
    def of(cls, table: DataFrame) -> Trees:
        """From the rows of ``table``."""
        rows = table.toArrow().to_pandas().sort_values("node")
        return cls(*_typed(np.flatnonzero(rows["root"]), rows["feature"], rows["number"], rows["left"]))

    def sent(self) -> list:
        context = SparkSession.active().sparkContext
        return [context.broadcast(b) for b in self.blocks()]

    def probability(self, features: Column) -> Column:
        """Mean over the trees of their leaves' probabilities, from a column of feature arrays; null for null."""
        sent, n = self.sent(), len(self)

        @F.arrow_udf("double")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in batches:
                there = rows.drop_null()
                p = np.full(len(rows), np.nan)
                gone = rows.is_null().to_numpy(zero_copy_only=False)
                p[~gone] = _votes(sent, _matrix(there)) / n
                yield pa.array(p, mask=gone)

        return of(features)


def passing(sent: list, trees: int, x: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the probability of each row of features passes the threshold, by the blocks of a forest of so many trees."""
    p = _votes(sent, x) / trees
    return p > 0.5 if threshold == 0.5 else p >= threshold


def _matrix(rows: pa.ListArray) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 1)


def _votes(sent: list, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for b in sent:
        total += b.value.votes(x)
    return total


def trees_from(nested: Sequence[tuple | float]) -> Trees:
    """Trees written as (feature, threshold, left, right), where feature <= threshold goes left; a leaf is its probability."""
    roots, columns = [], ([], [], [])

    def put(node: tuple | float) -> int:
        inner = isinstance(node, tuple)
        for column, v in zip(columns, (node[0], float(node[1]), 0) if inner else (-1, float(node), 0), strict=True):
            column.append(v)
        return len(columns[0]) - 1

    for tree in nested:
        roots.append(put(tree))
        waiting = [(roots[-1], tree)]
        while waiting:
            at, node = waiting.pop()
            if isinstance(node, tuple):
                left, right = put(node[2]), put(node[3])
                columns[2][at] = left
                waiting += [(left, node[2]), (right, node[3])]
    return Trees(*_typed(roots, *columns))


def _typed(roots, feature, number, left) -> tuple[np.ndarray, ...]:
    return np.asarray(roots, dtype=np.int32), np.asarray(feature, dtype=np.int16), np.asarray(number, dtype=float), np.asarray(left, dtype=np.int32)


def trees_from_nodes(nodes: pd.DataFrame) -> Trees:
    """Trees from rows (tree, id, left, right, feature, threshold, zero, one) sorted by tree and id, ids from 0 at the root.

    Rows are put in a new order in which siblings stand next to each other.
    """
    tree, n = nodes["tree"].to_numpy(), len(nodes)
    first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    base = np.repeat(first, np.diff(np.append(first, n)))
    inner = nodes["left"].to_numpy() >= 0
    parents = np.flatnonzero(inner)
    left, right = base[parents] + nodes["left"].to_numpy()[parents], base[parents] + nodes["right"].to_numpy()[parents]
    # the root of a tree first, then pairs of siblings in the order of their parents
    order = np.argsort(np.concatenate((first * 2, np.repeat(parents * 2 + 1, 2))), kind="stable")
    old = np.concatenate((first, np.column_stack((left, right)).ravel()))[order]
    # pairs of one tree may not move before the root of the next: parents lie inside their tree, so keys do
    new = np.empty(n, dtype=np.int64)
    new[old] = np.arange(n)
    zero, one = nodes["zero"].to_numpy(float), nodes["one"].to_numpy(float)
    whole = zero + one
    p = np.divide(one, whole, out=np.zeros(n), where=whole > 0)
    feature = np.where(inner, nodes["feature"].to_numpy(), -1)
    number = np.where(inner, nodes["threshold"].to_numpy(float), p)
    child = np.zeros(n, dtype=np.int64)
    child[parents] = new[left]
    return Trees(*_typed(new[first], feature[old], number[old], child[old]))
