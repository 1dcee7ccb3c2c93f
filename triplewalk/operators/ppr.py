"""Approximate personalised PageRank from every source at once, by level-synchronous push.

A source starts with paint 1. At each level a node keeps ``alpha`` of its paint; if it has ``eps`` or more, the rest flows along its
edges by weight, and paint that meets at a node is added before the next level. There are at most
``floor(ln eps / ln(1 - alpha)) + 2`` levels. Sources don't depend on one another.

Sources that share their out-edges are walked once (see ``shared``): the start of a class is -1 - its least member, and its walk keeps nothing of
the first level. Starts are spread over as many tasks as a shuffle has.

The same rule runs in two ways. Up to ``kernel_edges`` edges, counted first, the adjacency is broadcast as arrays and each task
pushes its own batches of sources with vectorised sorts; nothing is shuffled but the result. Beyond, each level is a
join with the edges and an aggregation, cut in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .shared import Vectors, classes, together

KERNEL_EDGES = 5_000_000


def check(alpha: float, eps: float) -> None:
    if not (0 < alpha <= 1 and eps > 0):
        raise ValueError("alpha must be in (0, 1] and eps above 0")


def level_bound(alpha: float, eps: float) -> int:
    return 2 if alpha == 1 else max(0, math.floor(math.log(eps) / math.log(1 - alpha))) + 2


def _kernel(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, pid: np.ndarray | None, runs: list[tuple[float, float]], shared: bool, most: int = 4_000_000):
    n = int(max(src.max(initial=-1), dst.max(initial=-1))) + 1
    order = np.argsort(src, kind="stable")
    dst, weight, pid = dst[order], weight[order], None if pid is None else pid[order]
    ptr = np.searchsorted(src[order], np.arange(n + 1))
    width = max(n, 1) if pid is None else max(n, int(pid.max(initial=-1)) + 1, 1)

    def merge(key, value):
        names, inverse = np.unique(key, return_inverse=True)
        return names, np.bincount(inverse, value, len(names))

    def push(sources: np.ndarray, alpha: float, eps: float):
        """(index of the source, node or predicate, value, and the value that a member of the class has there as its own)."""
        first = np.where(sources < 0, -1 - sources, sources)
        wide = max(width, int(first.max(initial=-1)) + 1)
        key, paint = np.arange(len(sources)) * wide + first, np.ones(len(sources))
        stays = sources >= 0
        keys, values = [], []
        while len(key):
            keys.append(key[stays])
            values.append(alpha * paint[stays])
            stays = slice(None)
            node = key % wide
            act = (paint >= eps) & (node < n)
            key, node, paint = key[act], node[act], paint[act]
            degree = ptr[node + 1] - ptr[node]
            edge = np.repeat(ptr[node] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
            base, flow = np.repeat(key - node, degree), np.repeat((1 - alpha) * paint, degree) * weight[edge]
            if pid is not None:
                k, v = merge(base + pid[edge], alpha * flow)
                keys.append(k)
                values.append(v)
            key, paint = merge(base + dst[edge], flow)
        if keys:
            names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.concatenate(values)
        else:
            names, inverse, value = key, key, paint
        # Added in the order of levels, as everywhere: first what stays at once.
        kept = np.bincount(np.concatenate([np.arange(len(names)), inverse]), np.concatenate([np.full(len(names), alpha), value]), len(names)) if shared else None
        return names // wide, names % wide, np.bincount(inverse, value, len(names)), kept

    def run(batches):
        for batch in batches:
            sources = batch.column(0).to_numpy(zero_copy_only=False)
            for alpha, eps in runs:
                # Row size is bounded by about 1 / (alpha * eps), and by the graph.
                step = int(max(1, min(2048, most // min(width, max(1.0, 1 / (alpha * eps))))))
                for lo in range(0, len(sources), step):
                    some = sources[lo : lo + step]
                    at, *found = push(some, alpha, eps)
                    for k in range(0, len(at), BATCH):
                        a = some[at[k : k + BATCH]]
                        columns = [a, np.full(len(a), alpha), np.full(len(a), eps), *[x[k : k + BATCH] for x in found if x is not None]]
                        yield pa.record_batch([pa.array(c) for c in columns], names=["src", "alpha", "eps", "ctx", "val", "kept"][: len(columns)])

    return run


NAMES, BATCH = ["src", "ctx", "val", "alpha", "eps"], 1 << 18


def _broadcast(edges: DataFrame, runs: list[tuple[float, float]]) -> Callable[..., DataFrame]:
    """A function from starts to their entries; those of classes (``shared``) also have ``kept``."""
    table = edges.toArrow()
    arrays = edges.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() if c in edges.columns else None for c in ("src", "dst", "weight", "pid")))

    def walk(starts: DataFrame, shared: bool = False) -> DataFrame:
        def run(batches):
            yield from _kernel(*arrays.value, runs, shared)(batches)

        # A few starts can make the whole result; sizes of starts tell nothing of it.
        tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return starts.repartition(max(1, min(tasks, starts.count()))).mapInArrow(run, "src bigint, alpha double, eps double, ctx bigint, val double" + (", kept double" if shared else ""))

    return walk


def _relational(starts: DataFrame, edges: DataFrame, runs: list[tuple[float, float]]) -> DataFrame:
    links = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).select(F.col("src").alias("node"), "dst", "weight"))
    frontier, levels = starts.select("src", F.when(F.col("src") < 0, -1 - F.col("src")).otherwise(F.col("src")).alias("node"), F.lit(1.0).alias("paint")), []
    run = [F.lit(float(x)).alias(n) for x, n in zip(runs[0], NAMES[3:])] if len(runs) == 1 else [F.col(n) for n in NAMES[3:]]
    by = NAMES[3:] if len(runs) > 1 else []
    if by:
        frontier = frontier.crossJoin(F.broadcast(starts.sparkSession.createDataFrame(runs, "alpha double, eps double")))
    frontier = cut(frontier)
    alpha, eps = run
    flows = (F.col("paint") >= eps) & ~F.isnan("paint")
    for _ in range(max(level_bound(*r) for r in runs) + 1):
        levels.append(frontier)
        flow = frontier.filter(flows).join(links, "node").select("src", F.col("dst").alias("node"), ((1 - alpha) * F.col("paint") * F.col("weight")).alias("paint"), *by)
        frontier = cut(flow.groupBy("src", "node", *by).agg(F.sum("paint").alias("paint")))
        if not frontier.take(1):
            break

    def union(parts: list[DataFrame]) -> DataFrame:
        while len(parts) > 1:  # balanced
            parts = [a.unionByName(b) if b is not None else a for a, b in zip(parts[::2], [*parts[1::2], None][: len(parts[::2])])]
        return parts[0]

    stays = union([levels[0].filter("src >= 0"), *levels[1:]])
    out = stays.select("src", F.col("node").alias("ctx"), (alpha * F.col("paint")).alias("val"), *by)
    if "pid" in edges.columns:
        sums = edges.groupBy(F.col("src").alias("node"), "pid").agg(F.sum("weight").alias("weight"))
        crossed = union(levels).filter(flows).join(sums, "node").select("src", F.col("pid").alias("ctx"), (alpha * (1 - alpha) * F.col("paint") * F.col("weight")).alias("val"), *by)
        out = out.unionByName(crossed)
    return out.groupBy("src", "ctx", *by).agg(F.sum("val").alias("val")).select("src", "ctx", "val", *run)


def walks(sources: DataFrame, ways: list[DataFrame], runs: list[tuple[float, float]], preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> list[Vectors]:
    """For each of ``ways(src, p, dst, weight)`` the vectors of the ``sources(src)`` by each (alpha, eps) of ``runs``, the classes the same in all."""
    for r in runs:
        check(*r)
    starts = cut(sources.select("src").distinct())
    pids = None if preds is None else preds.select(F.col("label").alias("p"), F.col("id").alias("pid"))
    ways = [cut(x.select("src", "dst", "weight") if pids is None else x.join(pids, "p").select("src", "dst", "weight", "pid")) for x in ways]
    of = classes(starts, *[x if pids is not None else x.withColumn("pid", F.lit(0)) for x in ways])
    shares = bool(of.take(1))
    alone = starts.join(of, "src", "left_anti") if shares else starts
    least = of.select((-1 - F.col("cls")).alias("src")).distinct()
    out = []
    for edges in ways:
        if edges.limit(kernel_edges + 1).count() > kernel_edges:
            found = _relational(alone.unionByName(least) if shares else alone, edges, runs)
            each, rest = found.filter("src >= 0"), found.filter("src < 0").withColumn("kept", F.col("alpha") + F.col("val"))
        else:
            walk = _broadcast(edges, runs)
            each, rest = walk(alone), walk(least, True) if shares else None
        each = each.select(*NAMES)
        out.append(Vectors.made(each, of, cut(rest.select((-1 - F.col("src")).alias("cls"), *NAMES[1:], "kept")), runs) if shares else Vectors(each))
    return out


def push_grid(sources: DataFrame, weighted: DataFrame, runs: list[tuple[float, float]], preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(src, ctx, val, alpha, eps): ``push`` for each (alpha, eps) of ``runs``, in one job over edges that are cut, and sent, once."""
    return walks(sources, [weighted], runs, preds, kernel_edges)[0].rows()


def push(sources: DataFrame, weighted: DataFrame, alpha: float, eps: float, preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """bcv(src, ctx, val) of the distinct ``sources(src)`` over ``weighted(src, p, dst, weight)``; with ``preds(id, label)`` also, under
    the predicate's id, the share of what crossed its edges that stayed at their targets. Entries of value 0 are kept.

    Paint that is NaN, as it comes from edges whose weights sum to 0, is kept where it arrives and goes no further.

    Up to ``kernel_edges`` edges (24 bytes each, 32 with predicates: 160 MB at most by default) the edges go to all tasks."""
    return push_grid(sources, weighted, [(alpha, eps)], preds, kernel_edges).select("src", "ctx", "val")


def push_normalized(sources: DataFrame, weighted: DataFrame, alpha: float, eps: float, preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``push``, each vector without its source's entry and divided by its sum."""
    return walks(sources, [weighted], [(alpha, eps)], preds, kernel_edges)[0].scaled()


def push_both(sources: DataFrame, weighted: DataFrame, back: DataFrame, alpha: float, eps: float, preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> Vectors:
    """The vectors of the walks over both, added."""
    return together(*walks(sources, [weighted, back], [(alpha, eps)], preds, kernel_edges))


def cached(nodes: DataFrame, weighted: DataFrame, alpha: float, eps: float, preds: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """bcv(src, ctx, val) of all nodes by memoised walks: a node's vector is ``alpha`` for itself and, of each out-neighbour's
    finished vector, the entries that stay above ``eps * alpha`` when scaled by the paint that flows there; with ``preds`` also what stayed
    of it, by predicate. Nodes go by level, a join and an aggregation each.

    Nodes that reach a cycle, or have a self loop, are walked by ``push``; others may use those vectors."""
    from .order import levels

    check(alpha, eps)
    edges = cut(weighted.select("src", "p", "dst", "weight"))
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    level = cut(levels(nodes, edges).join(loops, "id", "left_anti"))
    cyclic = nodes.select("id").join(level, "id", "left_anti").select(F.col("id").alias("src"))
    known = cut(push(cyclic, edges, alpha, eps, preds, kernel_edges))
    paint = (1 - alpha) * F.col("weight")
    of = edges.join(level.select(F.col("id").alias("src"), "level"), "src") if eps <= 1 else edges.limit(0).withColumn("level", F.lit(0).cast("bigint"))
    flow = cut(of.groupBy("level", "src", "dst").agg(F.sum(paint).alias("paint")))
    last = level.agg(F.max("level")).first()[0]
    for k in range(-1 if last is None else last + 1):
        vec = level.filter(F.col("level") == k).select(F.col("id").alias("src"), F.col("id").alias("ctx"), F.lit(float(alpha)).alias("val"))
        if k:
            scaled = F.col("val") * F.col("paint")
            vec = vec.unionByName(flow.filter(F.col("level") == k).select(F.col("src").alias("of"), F.col("dst").alias("src"), "paint").join(known, "src").filter((scaled > eps * alpha) & ~F.isnan(scaled)).select(F.col("of").alias("src"), "ctx", scaled.alias("val")))
            if preds is not None:
                crossed = of.filter(F.col("level") == k).join(preds.select(F.col("label").alias("p"), F.col("id").alias("ctx")), "p")
                vec = vec.unionByName(crossed.select("src", "ctx", (alpha * paint).alias("val")))
        known = known.unionByName(cut(vec.groupBy("src", "ctx").agg(F.sum("val").alias("val"))))
    return known
