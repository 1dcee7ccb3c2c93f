"""The order in which a memoising walk would want nodes: after their out-neighbours, cycles broken at the busiest node."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, number
from .graph import simple

KERNEL_EDGES = 5_000_000
#: Nodes that are sent to all tasks, 8 bytes each, where they go in one turn.
SENT = 200_000
#: Levels whose results are gathered before they are cut into one.
GATHERED = 32


class _Gathered:
    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) == GATHERED:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


class _Peel:
    """The pairs of a simple graph from which nodes go in turns, each after its out-neighbours. A turn reads the pairs and counts, by source, those
    that lead to nodes that go; pairs are written anew only when half of them have gone."""

    def __init__(self, pairs: DataFrame):
        self.rest, self.done, self.gone = cut(pairs), [], 0
        self.size = self.rest.count()
        self.left = cut(self.rest.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")))

    def first(self, nodes: DataFrame) -> tuple[DataFrame, int]:
        ready = cut(nodes.select("id").join(self.left, "id", "left_anti"))
        return ready, ready.count()

    def go(self, ready: DataFrame, n: int) -> tuple[DataFrame, int]:
        """``ready``, ``n`` nodes, go; the nodes that are ready next, and their number."""
        to = ready.select(F.col("id").alias("dst"))
        hits = cut(self.rest.join(F.broadcast(to) if n <= SENT else to, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")))
        self.done.append(to)
        self.gone += hits.agg(F.sum("k")).first()[0] or 0
        left = cut(self.left.join(hits, "id", "left").select("id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        self.left, after = left.filter("n > 0"), left.filter("n = 0").select("id")
        if self.size > self.gone >= self.size / 2 or len(self.done) >= GATHERED:
            self.prune()
        return after, after.count()

    def prune(self) -> None:
        if self.done:
            for to in self.done:
                self.rest = self.rest.join(to, "dst", "left_anti").select("src", "dst")
            self.rest, self.done, self.gone = cut(self.rest), [], 0
            self.size = self.rest.count()

    def busiest(self) -> list:
        """The node with the most in-neighbours that are left, the least of several, or none; its own pairs count no more."""
        self.prune()
        top = self.rest.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).collect()
        for r in top:
            self.rest, self.left = self.rest.filter(F.col("src") != r.id), self.left.filter(F.col("id") != r.id)
        return [(r.id,) for r in top]


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of the nodes whose walks end: level 0 has no out-neighbour, any other is one above its highest. Nodes that
    reach a cycle have no level; self loops and parallel edges don't count."""
    peel, out, k = _Peel(simple(edges)), _Gathered(), 0
    ready, n = peel.first(nodes)
    while True:
        out.add(ready.withColumn("level", F.lit(k).cast("bigint")))
        ready, n = peel.go(ready, n)
        if not n:
            return out.all()
        k += 1


def sequence(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The order of a graph that fits one task; see ``compute_order``. Edges are of the simple graph."""
    ids = np.unique(ids)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    n = len(ids)
    into, out = np.argsort(d, kind="stable"), np.argsort(s, kind="stable")
    into_at, out_at = (np.searchsorted(x[o], np.arange(n + 1)) for x, o in ((d, into), (s, out)))
    left, busy, done = np.bincount(s, minlength=n), np.bincount(d, minlength=n), np.zeros(n, bool)
    heap: list[tuple[int, int]] | None = None
    order: list[np.ndarray] = []
    ready = np.flatnonzero(left == 0)
    taken = 0

    def near(at, edges, nodes):
        size = at[nodes + 1] - at[nodes]
        return edges[np.repeat(at[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    while taken < n:
        if not len(ready):
            if heap is None:
                heap = [(-int(busy[i]), int(i)) for i in np.flatnonzero(~done)]
                heapq.heapify(heap)
            while True:
                b, i = heapq.heappop(heap)
                if not done[i] and -b == busy[i]:
                    break
            ready = np.array([i])
        done[ready] = True
        order.append(ready)
        taken += len(ready)
        after = d[near(out_at, out, ready)]
        np.subtract.at(busy, after, 1)
        if heap is not None:
            for i in np.unique(after[~done[after]]).tolist():
                heapq.heappush(heap, (-int(busy[i]), i))
        before = s[near(into_at, into, ready)]
        np.subtract.at(left, before, 1)
        before = np.unique(before)
        ready = before[(left[before] == 0) & ~done[before]]
    return ids[np.concatenate(order)] if order else ids


def compute_order(nodes: DataFrame, edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """order(pos BIGINT, id BIGINT): a permutation of all nodes; an empty graph has an empty one.

    In turns, all nodes whose out-neighbours have gone go, by id; where there is none, the node with the most remaining in-neighbours goes, of
    several the least id. Self loops and parallel edges don't count.

    Up to ``kernel_edges`` edges and nodes, counted first (16 bytes each), one task orders the graph; beyond, every turn is a join. The order is
    the same."""
    pairs = simple(edges)
    if pairs.limit(kernel_edges + 1).count() <= kernel_edges and nodes.limit(kernel_edges + 1).count() <= kernel_edges:

        def run(batches):
            table = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
            if table:
                src, dst = (np.concatenate(c) for c in zip(*table))
                order = sequence(src[dst < 0], src[dst >= 0], dst[dst >= 0])
                yield pa.record_batch([pa.array(np.arange(len(order))), pa.array(order)], names=["pos", "id"])

        both = nodes.select(F.col("id").alias("src"), F.lit(-1).cast("bigint").alias("dst")).unionByName(pairs)
        return both.repartition(1).mapInArrow(run, "pos bigint, id bigint")
    peel, out, pos = _Peel(pairs), _Gathered(), 0
    ready, n = peel.first(nodes)
    while True:
        if not n:
            top = peel.busiest()
            if not top:
                break
            ready, n = nodes.sparkSession.createDataFrame(top, "id bigint"), 1
        out.add(number(ready, [F.col("id")], "pos", pos).select("pos", "id"))
        pos += n
        ready, n = peel.go(ready, n)
    return out.all() if out.parts else nodes.select(F.lit(0).cast("bigint").alias("pos"), "id").limit(0)


def is_permutation(order: DataFrame, n: int) -> bool:
    """Whether the ids are 0 to n - 1, each once."""
    r = order.agg(F.count("id").alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("m"), F.min("id").alias("l")).first()
    return (r.n, r.d) == (n, n) and (n == 0 or (r.l, r.m) == (0, n - 1))
