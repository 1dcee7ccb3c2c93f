"""Vectors that sources share: the same as each source's own walk, in every form, and written out by many tasks."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from triplewalk.functions import weighers as w
from triplewalk.operators import vectors as v
from triplewalk.operators.ppr import push, push_both, push_normalized, walks
from triplewalk.operators.shared import Vectors, classes
from triplewalk.plans import queries


def star(spark, leaves=40, hubs=3):
    """Leaves that lead to a hub, some by two predicates, hubs that lead back, to a root and to themselves; two nodes without edges."""
    links = [(i, "p", leaves + i % hubs) for i in range(leaves)] + [(i, "q", leaves + i % hubs) for i in range(0, leaves, 4)]
    links += [(leaves + i % hubs, "r", i) for i in range(leaves)] + [(leaves + h, "r", leaves + hubs) for h in range(hubs)] + [(leaves, "q", leaves)]
    n = leaves + hubs + 3
    nodes = spark.createDataFrame([(i, f"<{i}>") for i in range(n)], "id bigint, label string")
    edges = spark.createDataFrame([(a, k, p, b) for k, (a, p, b) in enumerate(links)], "src bigint, eord bigint, p string, dst bigint")
    preds = spark.createDataFrame([(n + k, p) for k, p in enumerate("pqr")], "id bigint, label string")
    return nodes, edges, preds


def brute(nodes, weighted, preds, alpha, eps):
    out, pid, found = {}, {r.label: r.id for r in preds.collect()}, {}
    for r in weighted.collect():
        out.setdefault(r.src, []).append((pid[r.p], r.dst, r.weight))
    for s in (r.id for r in nodes.collect()):
        level = {s: 1.0}
        while level:
            after = {}
            for i, x in level.items():
                found[s, i] = found.get((s, i), 0) + alpha * x
                for p, j, weight in out.get(i, ()) if x >= eps else ():
                    after[j] = after.get(j, 0) + (1 - alpha) * x * weight
                    found[s, p] = found.get((s, p), 0) + alpha * (1 - alpha) * x * weight
            level = after
    return found


def matrix(df):
    rows = df.collect()
    found = {(r.src, r.ctx): r.val for r in rows}
    assert len(found) == len(rows)
    return found


def same(a, b):
    assert a.keys() == b.keys() and all(x == pytest.approx(b[k], abs=1e-13) or math.isnan(x) and math.isnan(b[k]) for k, x in a.items())


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_shared_walks(spark, kernel):
    nodes, rows, preds = star(spark)
    sources, forward, back = nodes.select(F.col("id").alias("src")), w.uniform(rows), w.inverse_predicate_frequency(rows.select(F.col("dst").alias("src"), "eord", "p", F.col("src").alias("dst")))
    want, other = brute(nodes, forward, preds, 0.4, 1e-3), brute(nodes, back, preds, 0.4, 1e-3)
    same(matrix(push(sources, forward, 0.4, 1e-3, preds, kernel)), want)
    both = push_both(sources, forward, back, 0.4, 1e-3, preds, kernel)
    added = {k: want.get(k, 0) + other.get(k, 0) for k in want.keys() | other.keys()}
    assert both.of.count() > 30
    same(matrix(both.rows()), added)
    same(matrix(both.above(0.02).rows()), {k: x for k, x in added.items() if x > 0.02})
    for found, vectors in ((push_normalized(sources, forward, 0.4, 1e-3, preds, kernel), want), (both.scaled(), added)):
        sums = {}
        for (s, c), x in vectors.items():
            sums[s] = sums.get(s, 0) + (x if s != c else 0)
        same(matrix(found), {(s, c): x / sums[s] for (s, c), x in vectors.items() if s != c and sums[s]})


def test_runs_of_a_grid(spark):
    nodes, rows, preds = star(spark)
    sources, edges = nodes.select(F.col("id").alias("src")), w.uniform(rows)
    grid = walks(sources, [edges], [(0.3, 1e-3), (0.7, 1e-4), (0.5, 2.0)], preds)[0]
    for alpha, eps in ((0.3, 1e-3), (0.7, 1e-4), (0.5, 2.0)):
        same(matrix(grid.run(alpha, eps).rows()), brute(nodes, edges, preds, alpha, eps))


def test_classes_are_of_equal_edges(spark):
    sources = spark.createDataFrame([(i,) for i in range(9)], "src bigint")
    rows = [(0, 7, 1.0, 1), (1, 7, 1.0, 1), (2, 7, 1.0, 2), (3, 7, 0.5, 1), (3, 8, 0.5, 2), (4, 8, 0.5, 2), (4, 7, 0.5, 1), (5, 7, 0.5, 2), (5, 8, 0.5, 1), (7, 0, 0.2, 1), (7, 1, 0.2, 1), (7, 2, 0.6, 1), (8, 0, 0.2, 1), (8, 1, 0.2, 1), (8, 2, 0.6, 1)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, weight double, pid bigint")
    assert sorted(map(tuple, classes(sources, edges).collect())) == [(0, 0), (1, 0), (3, 3), (4, 3)]
    assert classes(sources, edges, edges.filter("src = 0")).select("src").distinct().count() == 2


def test_a_member_that_has_nearly_all(spark):
    """Sums without an entry are no differences of near values."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    of = frame([(1, 1), (2, 1), (3, 1)], "src bigint, cls bigint")
    rest = frame([(1, 1, 1.0, 1.5, 0.5, 1e-3), (1, 2, 1e-17, 0.5, 0.5, 1e-3), (1, 9, 3e-17, 0.5, 0.5, 1e-3)], "cls bigint, ctx bigint, val double, kept double, alpha double, eps double")
    none = frame([], "src bigint, ctx bigint, val double, alpha double, eps double")
    got = matrix(Vectors.made(none, of, rest, [(0.5, 1e-3)]).scaled())
    assert got[1, 2] == pytest.approx(0.25) and got[1, 9] == pytest.approx(0.75) and got[3, 1] == pytest.approx(1) and (2, 2) not in got


def test_labelled_shared(spark):
    nodes, rows, preds = star(spark)
    edges, names = w.uniform(rows), nodes.filter("id <> 7").unionByName(preds.withColumn("label", F.lit("<5>")))
    found = walks(nodes.select(F.col("id").alias("src")), [edges], [(0.4, 1e-3)], preds)[0]
    want = {r.src: json.loads(r.text) for r in v.labelled(found.rows().select("src", "ctx", "val"), names).collect()}
    assert {r.src: json.loads(r.text) for r in found.labelled(names).collect()} == want and len(want) > 40


def test_results_are_written_by_many_tasks(spark):
    """Not by the one that a few starts fit into."""
    nodes, rows, _ = star(spark, 5000, 1)
    bcv = push(nodes.select(F.col("id").alias("src")), w.uniform(rows), 0.7, 1e-5)
    sizes = [r["count"] for r in bcv.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(sizes) > 25_000_000 and max(sizes) < 5_000_000


def test_triples_are_written_by_many_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = queries.written_triples(spark, "/root/testdata/sf0.001", queries.ALL).removeprefix("file:")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = [f for f in sorted(os.listdir(path)) if f.startswith("part-")]
    assert len(files) > 3 and max(os.path.getsize(f"{path}/{f}") for f in files) < sum(os.path.getsize(f"{path}/{f}") for f in files) * 0.6
