"""Random graphs: both ways of each operator give one answer, which brute force has, too."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewalk import compat
from triplewalk.functions import weighers as w
from triplewalk.operators import order as o
from triplewalk.operators import vectors as v
from triplewalk.operators.cooc import CoOccurrence
from triplewalk.operators.ppr import cached, push, push_grid


def graph(spark, seed, n=14, m=30, acyclic=False):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.choice("pqr"), rng.randrange(n)) for _ in range(m)]
    if acyclic:
        edges = [(max(a, b), p, min(a, b)) for a, p, b in edges if a != b]
    nodes = spark.createDataFrame([(i, f"<{i}>") for i in range(n)], "id bigint, label string")
    rows = spark.createDataFrame([(a, k, p, b) for k, (a, p, b) in enumerate(edges)], "src bigint, eord bigint, p string, dst bigint")
    preds = spark.createDataFrame([(n + k, p) for k, p in enumerate("pqr")], "id bigint, label string")
    return nodes, rows, preds, edges


def brute_order(n, edges):
    pairs, left, out = {(a, b) for a, _, b in edges if a != b}, set(range(n)), []
    while left:
        live = {(a, b) for a, b in pairs if a in left and b in left}
        ready = sorted(left - {a for a, _ in live})
        if not ready:
            into = {i: sum(b == i for _, b in live) for i in left}
            ready = [min(left, key=lambda i: (-into[i], i))]
        out += ready
        left -= set(ready)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_order_has_one_definition(spark, seed):
    nodes, rows, _, edges = graph(spark, seed, 9, (4, 9, 18, 30)[seed])
    want = brute_order(9, edges)
    for kernel in (10**6, 0):
        assert [r.id for r in o.compute_order(nodes, rows, kernel).orderBy("pos").collect()] == want
    assert o.is_permutation(o.compute_order(nodes, rows), 9)


def test_sequence_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        n, m = rng.randrange(1, 12), rng.randrange(40)
        edges = [(rng.randrange(n), "", rng.randrange(n)) for _ in range(m)]
        pairs = np.array(sorted({(a, b) for a, _, b in edges if a != b}), np.int64).reshape(-1, 2)
        assert o.sequence(np.arange(n), pairs[:, 0], pairs[:, 1]).tolist() == brute_order(n, edges)


def same(a, b):
    a, b = ({(*r[:2], *r[3:]): r.val for r in x.select("src", "ctx", "val", *[c for c in ("alpha", "eps") if c in x.columns]).collect()} for x in (a, b))
    assert a.keys() == b.keys()
    assert all(x == pytest.approx(b[k], abs=1e-12) or (math.isnan(x) and math.isnan(b[k])) for k, x in a.items())
    return a


def test_push_has_one_answer(spark):
    for seed in (0, 1):
        nodes, rows, preds, _ = graph(spark, 20 + seed)
        # Some nodes' edges lead to weight 0 alone, so their weights aren't numbers.
        weights = spark.createDataFrame([(i, float(i % 3 if seed else 0 if i < 7 else 1)) for i in range(14)], "id bigint, w double")
        edges = w.push_down(weights)(rows)
        assert edges.filter(F.isnan("weight")).count()
        sources = nodes.select(F.col("id").alias("src"))
        found = same(push_grid(sources, edges, [(0.4, 1e-3), (0.7, 1e-4)], preds), push_grid(sources, edges, [(0.4, 1e-3), (0.7, 1e-4)], preds, kernel_edges=0))
        assert any(math.isnan(x) for x in found.values())
        same(push(sources, edges, 0.4, 1e-3), push(sources, edges, 0.4, 1e-3, kernel_edges=0))


def test_nan_goes_no_further(spark):
    edges = spark.createDataFrame([(0, "p", 1, float("nan")), (1, "p", 2, 1.0), (2, "p", 3, 1.0)], "src bigint, p string, dst bigint, weight double")
    sources = spark.createDataFrame([(0,)], "src bigint")
    for kernel in (10, 0):
        got = {r.ctx: r.val for r in push(sources, edges, 0.5, 1e-3, kernel_edges=kernel).collect()}
        assert got.keys() == {0, 1} and got[0] == 0.5 and math.isnan(got[1])


@pytest.mark.parametrize(("seed", "acyclic"), [(30, True), (31, True), (32, False)])
def test_cached_walks(spark, seed, acyclic):
    nodes, rows, preds, _ = graph(spark, seed, m=25, acyclic=acyclic)
    edges = w.uniform(rows)
    for p in (preds, None):
        got = {(r.src, r.ctx): r.val for r in cached(nodes, edges, 0.6, 1e-3, p).collect()}
        assert {s for s, _ in got} == set(range(14))
        if acyclic:
            want = {(r.src, r.ctx): r.val for r in compat.vectors(nodes, edges, preds, 0.6, 1e-3, with_edges=p is not None).collect()}
            assert got.keys() == want.keys() and all(x == pytest.approx(want[k], rel=1e-5) for k, x in got.items())
        else:
            plain = {(r.src, r.ctx): r.val for r in push(nodes.select(F.col("id").alias("src")), edges, 0.6, 1e-3, p).collect()}
            assert all(abs(plain.get(k, 0) - got.get(k, 0)) < 0.05 for k in plain.keys() | got.keys())
    assert cached(nodes.limit(0), edges.limit(0), 0.6, 1e-3).count() == 0


def test_a_given_order(spark):
    triples = spark.createDataFrame([(0, "<a>", "<p>", "<b>"), (1, "<b>", "<p>", "<c>")], "ord bigint, s string, p string, o string")
    order = lambda ids: spark.createDataFrame(list(enumerate(ids)), "pos bigint, id bigint")
    c = CoOccurrence(triples, w.uniform, order=order([2, 1, 0]))
    assert {(r.src, r.ctx) for r in c.sequential(0.5, 1e-3, edges=False).collect()} == {(r.src, r.ctx) for r in c.cached(0.5, 1e-3, edges=False).collect()}
    with pytest.raises(ValueError):
        CoOccurrence(triples, w.uniform, order=order([2, 1]))


def test_labels_that_are_twice(spark):
    bcv = spark.createDataFrame([(0, 0, 0.5), (0, 3, 0.25)], "src bigint, ctx bigint, val double")
    both = spark.createDataFrame([(0, "<p>"), (3, "<p>")], "id bigint, label string")
    assert v.labelled(bcv, both).first().text == '[{"label":"<p>","id":0,"val":0.5},{"label":"<p>","id":3,"val":0.25}]'


def test_a_level_does_not_write_all_edges_anew(spark, monkeypatch):
    """A long way beside many edges that stay to the end: what is cut in a turn is of the size of nodes."""
    way = [(i + 1, i) for i in range(12)]
    wide = [(100 + i, j) for i in range(30) for j in (0, 1, 2, 12)]
    nodes = spark.createDataFrame([(i,) for i in [*range(13), *range(100, 130)]], "id bigint")
    edges = spark.createDataFrame(way + wide, "src bigint, dst bigint")
    sizes, cut = [], o.cut
    monkeypatch.setattr(o, "cut", lambda df: sizes.append((x := cut(df)).count()) or x)
    found = {r.id: r.level for r in o.levels(nodes, edges).collect()}
    assert found == {i: i for i in range(13)} | {100 + i: 13 for i in range(30)}
    assert sum(n > len(found) for n in sizes) <= 3
