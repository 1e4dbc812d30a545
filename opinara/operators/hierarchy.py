"""Agglomerative clustering by Ward's criterion over cluster features, for tables of any size.

Rows are first summed up in cluster features (how many, their sum, the sum of their squares). Each task grows a tree of
them: a row goes down to the nearest entry and is added to it if the entry's radius stays within the threshold; otherwise
it is an entry of its own, and full nodes are split. When a tree has more than ``leaves`` entries, the threshold is raised
and the entries are put into a new tree. The tasks' entries are merged in the same way, a few tasks' at a time, until one
task holds all. Ward's merges are then found among these bounded entries by nearest-neighbour chains, and every row takes
the cluster of its nearest entry. A table with no more than ``leaves`` distinct rows has threshold 0: its merges are
exactly Ward's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Entries that all rows are summed up in, entries of a tree's node, and tasks whose entries one task merges.
LEAVES, WIDTH, FAN_IN = 1024, 32, 8
_CF = "part int, n double, total array<double>, squares double"


class _Node:
    """Entries (n, total, squares) of a tree's node, and their children where it isn't a leaf."""

    def __init__(self, d: int, leaf: bool):
        self.n, self.total, self.squares = np.zeros(WIDTH + 1), np.zeros((WIDTH + 1, d)), np.zeros(WIDTH + 1)
        self.size, self.children = 0, None if leaf else []

    def append(self, n: float, total: np.ndarray, squares: float, child: "_Node | None" = None) -> None:
        k = self.size
        self.n[k], self.total[k], self.squares[k], self.size = n, total, squares, k + 1
        if child is not None:
            self.children.append(child)

    def centres(self) -> np.ndarray:
        return self.total[: self.size] / self.n[: self.size, None]

    def whole(self) -> tuple[float, np.ndarray, float]:
        k = self.size
        return self.n[:k].sum(), self.total[:k].sum(0), self.squares[:k].sum()

    def split(self) -> tuple["_Node", "_Node"]:
        """The entries dealt to the two that are farthest apart."""
        c = self.centres()
        apart = ((c[:, None] - c[None]) ** 2).sum(2)
        a, b = np.unravel_index(np.argmax(apart), apart.shape)
        parts = _Node(c.shape[1], self.children is None), _Node(c.shape[1], self.children is None)
        to_b = apart[:, b] < apart[:, a]
        to_b[a], to_b[b] = False, True
        for k in range(self.size):
            child = None if self.children is None else self.children[k]
            parts[int(to_b[k])].append(self.n[k], self.total[k], self.squares[k], child)
        return parts


class FeatureTree:
    """A tree of cluster features with at most ``leaves`` entries in its leaves."""

    def __init__(self, d: int, leaves: int = LEAVES):
        self.d, self.leaves, self.threshold = d, leaves, 0.0
        self._clear()

    def _clear(self) -> None:
        self.root, self.entries = _Node(self.d, True), 0

    def _put(self, node: _Node, n: float, total: np.ndarray, squares: float) -> tuple[_Node, _Node] | None:
        """Adds an entry below node; the two nodes that node is split into, if it is."""
        if node.size:
            gap = node.centres() - total / n
            k = int(np.argmin(np.einsum("ij,ij->i", gap, gap)))
            if node.children is None:
                m, t, s = node.n[k] + n, node.total[k] + total, node.squares[k] + squares
                near = float(gap[k] @ gap[k]) == 0.0  # equal rows are one entry whatever the rounding
                if near or s / m - float(t @ t) / m**2 <= self.threshold:
                    node.n[k], node.total[k], node.squares[k] = m, t, s
                    return None
            else:
                parts = self._put(node.children[k], n, total, squares)
                if parts is None:
                    node.n[k] += n
                    node.total[k] += total
                    node.squares[k] += squares
                    return None
                node.children[k] = parts[0]
                node.n[k], node.total[k], node.squares[k] = parts[0].whole()
                node.append(*parts[1].whole(), parts[1])
                return node.split() if node.size > WIDTH else None
        node.append(n, total, squares)
        self.entries += 1
        return node.split() if node.size > WIDTH else None

    def add(self, n: float, total: np.ndarray, squares: float) -> None:
        parts = self._put(self.root, n, total, squares)
        if parts is not None:
            self.root = _Node(self.d, False)
            for p in parts:
                self.root.append(*p.whole(), p)
        while self.entries > self.leaves:
            self._rebuild()

    def _rebuild(self) -> None:
        """A higher threshold, at which neighbours in the leaves merge, and all entries anew."""
        nearest = []
        for leaf in self._leaf_nodes(self.root):
            if leaf.size > 1:
                c, n = leaf.centres(), leaf.n[: leaf.size]
                gap = ((c[:, None] - c[None]) ** 2).sum(2)
                np.fill_diagonal(gap, np.inf)
                j = gap.argmin(1)
                own = leaf.squares[: leaf.size] - n * (c**2).sum(1)
                m = n + n[j]
                nearest.append((own + own[j] + n * n[j] / m * gap.min(1)) / m)
        step = float(np.median(np.concatenate(nearest))) if nearest else 0.0
        self.threshold = max(step, self.threshold * 1.5, 1e-12)
        held = list(self.items())
        self._clear()
        for item in held:
            parts = self._put(self.root, *item)
            if parts is not None:
                self.root = _Node(self.d, False)
                for p in parts:
                    self.root.append(*p.whole(), p)

    def _leaf_nodes(self, node: _Node) -> Iterator[_Node]:
        if node.children is None:
            yield node
        else:
            for child in node.children:
                yield from self._leaf_nodes(child)

    def items(self) -> Iterator[tuple[float, np.ndarray, float]]:
        for leaf in self._leaf_nodes(self.root):
            for k in range(leaf.size):
                yield float(leaf.n[k]), leaf.total[k].copy(), float(leaf.squares[k])


def _out(tree: FeatureTree | None, part: int) -> pa.RecordBatch:
    held = [] if tree is None else list(tree.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(held), pa.int32()), pa.array([x[0] for x in held], pa.float64()),
            pa.array([x[1] for x in held], pa.list_(pa.float64())), pa.array([x[2] for x in held], pa.float64())
        ], ["part", "n", "total", "squares"]
    )


def cluster_features(vectors: DataFrame, features: str = "features", leaves: int = LEAVES) -> DataFrame:
    """(n, total, squares) of at most ``leaves`` entries that sum up all rows; rows with a null vector don't count."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree = None
        for batch in batches:
            for v in batch.column(0):
                x = v.values.to_numpy()
                tree = tree or FeatureTree(len(x), leaves)
                tree.add(1.0, x, float(x @ x))
        yield _out(tree, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part = None, 0
        for batch in batches:
            for p, n, total, squares in zip(*batch.columns, strict=True):
                x, part = total.values.to_numpy(), p.as_py()
                tree = tree or FeatureTree(len(x), leaves)
                tree.add(n.as_py(), x, squares.as_py())
        yield _out(tree, part)

    slim = vectors.filter(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"))
    found = stored(slim.mapInArrow(grow, _CF))
    parts = found.select("part").distinct().count()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        # At most FAN_IN tasks' entries meet in one task.
        dealt = found.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).repartitionByRange(parts, "part")
        found = stored(dealt.mapInArrow(merge, _CF))
        parts = found.select("part").distinct().count()
    return found.select("n", "total", "squares")


def ward_merges(centres: np.ndarray, counts: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges by Ward's criterion, lowest first; a and b are members of the clusters that merge.

    Nearest-neighbour chains: from any cluster go to its nearest until two are nearest to each other, and merge those.
    That finds the same merges as taking the closest pair each time, with distances to one cluster at a time.
    """
    c, n = centres.astype(float).copy(), counts.astype(float).copy()
    live = np.ones(len(c), bool)
    chain: list[int] = []
    out = []
    for _ in range(len(c) - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            gap = ((c - c[a]) ** 2).sum(1) * (n * n[a] / (n + n[a]))
            gap[~live] = np.inf
            gap[a] = np.inf
            b = int(np.argmin(gap))
            if len(chain) > 1 and gap[chain[-2]] <= gap[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        out.append((float(gap[b]), a, b))
        c[b] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[b] += n[a]
        live[a] = False
    return sorted(out, key=lambda x: x[0])


def cut(merges: list[tuple[float, int, int]], size: int, k: int) -> np.ndarray:
    """Cluster numbers 0..k-1 of the entries after the lowest merges, by first member."""
    top = list(range(size))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for _, a, b in merges[: max(0, size - k)]:
        top[find(a)] = find(b)
    return np.unique([find(i) for i in range(size)], return_inverse=True)[1]


class WardClusters:
    """Ward's clusters of a table of vectors: the entries, their merges, and the number of clusters chosen."""

    def __init__(self, leaves: int = LEAVES):
        self.leaves, self.k, self.silhouette = leaves, None, None

    def fit(self, vectors: DataFrame, features: str = "features") -> "WardClusters":
        self.features = features
        held = cluster_features(vectors, features, self.leaves).collect()  # leaves at most
        if not held:
            raise ValueError("there are no vectors to cluster")
        held.sort(key=lambda r: (list(np.asarray(r["total"]) / r["n"]), r["n"]))
        self.n = np.array([r["n"] for r in held])
        self.centres = np.array([r["total"] for r in held]).reshape(len(held), -1) / self.n[:, None]
        self.merges = ward_merges(self.centres, self.n)
        return self

    def nearest(self, vectors: DataFrame, into: str = "entry") -> DataFrame:
        """vectors with the number of each row's nearest entry, null for a null vector."""
        centres, square = self.centres, (self.centres**2).sum(1)
        names = vectors.columns

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(len(names))
                out = np.zeros(len(x), np.int32)
                known = np.asarray(x.is_valid())
                if known.any():
                    rows = np.stack([v.values.to_numpy() for v in x if v.is_valid])
                    for a in range(0, len(rows), 4096):
                        gap = square - 2 * rows[a : a + 4096] @ centres.T
                        out[np.flatnonzero(known)[a : a + 4096]] = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, mask=~known)], [*names, into])

        # The vector column itself goes through unread.
        kinds = {f.name: f.dataType for f in vectors.schema}
        plain = [c for c in names if c != self.features]
        own = F.when(F.col(self.features).isNotNull(), vector_to_array(self.features))
        rest = vectors.withColumn("_x", own).drop(self.features)
        names = plain
        schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in plain), f"{into} int"])
        return rest.select(*[f"`{c}`" for c in plain], "_x").mapInArrow(find, schema)

    def transform(self, vectors: DataFrame, k: int | None = None, into: str = "cluster") -> DataFrame:
        """vectors without their vector column, with the cluster of each row at k clusters."""
        of = cut(self.merges, len(self.centres), k or self.k)
        near = self.nearest(vectors, "_entry")
        known = F.array(*[F.lit(int(x)) for x in of])
        return near.withColumn(into, F.get(known, F.col("_entry"))).drop("_entry")

    def choose(self, vectors: DataFrame, ks: range = range(2, 21)) -> "WardClusters":
        """k with the best silhouette over all rows, the least on ties; entries are looked up once for all k.

        With one distinct row there is one cluster, and no silhouette.
        """
        key = "_row"
        rows = stored(vectors.select(F.monotonically_increasing_id().alias(key), self.features).dropna())
        near = stored(self.nearest(rows, "_entry"))
        both = stored(rows.join(near, key))
        self.k, self.silhouette = 1, None
        for k in [k for k in ks if 2 <= k <= len(self.centres)]:
            known = F.array(*[F.lit(int(x)) for x in cut(self.merges, len(self.centres), k)])
            out = both.withColumn("cluster", F.get(known, F.col("_entry")))
            value = ClusteringEvaluator(featuresCol=self.features, predictionCol="cluster").evaluate(out)
            if self.silhouette is None or value > self.silhouette:
                self.k, self.silhouette = k, value
        return self
