"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a partial ``min`` per node, so a hub's edges are combined before the shuffle, and an equi-join.
Hubs are nodes of so many edges that their table is small by arithmetic; it is broadcast, so that a hub's edges stay
where they are. Edges are only ever re-pointed at smaller nodes, their number never grows, and nothing but counts
reach the driver. Components that are stars around their smallest node are done and leave the rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnpike.llm._store import cut


#: Edges above which a node is a hub, at least, and hubs at most: edges over this number make hubs rarer.
HUB_EDGES, MOST_HUBS = 512, 200_000


#: Edges from which on stars leave the rounds, if they are half of all, and nodes up to which the table that tells the others is broadcast.
SPLIT_EDGES, MOST_OPEN = 20_000, 200_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _low(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _unsettled(edges: DataFrame, among: DataFrame, n: int) -> DataFrame | None:
    """Smaller ends of the edges in components that aren't stars around their smallest node; None if they are too many to tell.

    ``among`` holds the open nodes. An edge is in a star unless its smaller end is open or next to an open node above it.
    """
    if among.count() > MOST_OPEN:
        return None
    above = edges.join(F.broadcast(among), F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node"))
    ends = cut(above.unionByName(among).distinct(), n)
    return ends if ends.count() <= MOST_OPEN else None


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges(a, b)`` with long ids -> ``(node, root)`` for every node that is not the smallest of its component.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows. ``rows`` bounds their number, if known.
    """
    current = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        rows,
    )
    n, done = current.count(), []
    while n:
        # A node is open if it has several neighbours, one of them smaller. Without open nodes all components are stars.
        among = cut(_low(_both(current)).where((F.col("m") < F.col("u")) & (F.col("n") > 1)).select(F.col("u").alias("node")), n)
        if among.isEmpty():
            break
        ends = _unsettled(current, among, n) if n >= SPLIT_EDGES else None
        if ends is not None:
            on = F.col("v") == F.col("node")
            left = cut(current.join(F.broadcast(ends), on, "left_semi"), n)
            if 2 * (still := left.count()) <= n:
                done.append(cut(current.join(F.broadcast(ends), on, "left_anti"), n - still))
                current, n = left, still
        both = _both(current)
        # Both directions of n edges hold at most MOST_HUBS nodes of more than 2 n / MOST_HUBS edges.
        limit = max(HUB_EDGES, 2 * n // MOST_HUBS)
        low = _low(both)
        hubs = F.broadcast(low.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
        up = both.where(F.col("v") > F.col("u")).join(hubs, F.col("u") == F.col("hub"), "left")
        others = up.where(F.col("hub").isNull()).join(low.where(F.col("n") <= limit), "u")
        large = (
            up.where(F.col("hub").isNotNull())
            .select(F.col("v").alias("u"), F.least("u", "hub_m").alias("v"))
            .unionByName(others.select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        current = cut(small, n)
        n = current.count()
    for part in done:
        current = current.unionByName(part)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Forest:
    """Union-find over 0..n-1 that takes its links in vectorised blocks; the memory is two arrays of n."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of ``a[i]`` and ``b[i]``; labels are always fully resolved afterwards."""
        x, y = self.label[a], self.label[b]
        differ = x != y
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.minimum(x, y)[differ], np.maximum(x, y)[differ]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def root(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = parent.get(up, up)
                k = up
            return k

        for s, t in pairs.tolist():
            s, t = root(s), root(t)
            if s != t:
                parent[max(s, t)] = min(s, t)
        old = np.array(list(parent), dtype=np.int64)
        new = np.array([root(k) for k in parent], dtype=np.int64)
        table = np.arange(len(self.label), dtype=np.int64)
        table[old] = new
        self.label = table[self.label]

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(id, smallest id of its class)`` for all members that are not the smallest."""
        order = np.lexsort((ids, self.label))
        first = np.ones(len(ids), dtype=bool)
        first[1:] = self.label[order][1:] != self.label[order][:-1]
        low = np.empty(len(ids), dtype=ids.dtype)
        low[self.label[order[first]]] = ids[order[first]]
        root = low[self.label]
        other = root != ids
        return ids[other], root[other]
