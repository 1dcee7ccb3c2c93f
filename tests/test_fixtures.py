"""Small graphs whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from triplewalk import compat
from triplewalk.functions import weighers as w
from triplewalk.operators import graph as g
from triplewalk.operators import order as o
from triplewalk.operators.cooc import CoOccurrence
from triplewalk.operators.ppr import level_bound, push
from triplewalk.sources import text

TYPE, THING = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2002/07/owl#Thing>"
CYCLE = ["<A> <beta> <B> .", "<A> <gamma> <B> .", "<B> <delta> <C>.", "<C> <beta> <A> .", "<C> <beta> <D> ."]
GRAPHS = {
    "one": (["<A> <delta> <B> ."], 2, 1, 3, 4, 0.91),
    "parallel": (CYCLE[:3], 3, 3, 6, 10, 0.973),
    "cycle": (CYCLE[:4], 3, 4, 9, 18, 0.999998),
    "exit": (CYCLE, 4, 5, 13, 22, 0.995892),
    "duplicates": ([*CYCLE[:4], "", CYCLE[4], CYCLE[1], CYCLE[2]], 4, 5, 13, 22, 0.995892),
    "literals": ([CYCLE[0], CYCLE[1], '<C> <beta> "jeee" .', '<A> <gamma> "12.3"^<xsd:string> .', CYCLE[2]], 3, 3, 6, 10, 0.973),
    "things": ([*CYCLE[:3], f"<A> {TYPE} {THING} .", *CYCLE[3:], f"<B> {TYPE} {THING} .", "", f"<D> {TYPE} {THING} ."], 5, 8, 18, 31, 0.96041),
    "pairs": ([*CYCLE, *[f"<{x}> {TYPE} {THING} ." for x in "ABCD"]], 5, 9, 18, 31, 0.959699),
    "loop": (["<A> <beta> <B> .", "<B> <beta> <C> .", "<C> <beta> <A> .", "<A> <beta> <D> .", "<B> <beta> <D> ."], 4, 5, 13, 16, 0.947892),
    "self": (["<A> <beta> <B> .", "<B> <beta> <C> .", "<C> <beta> <A> .", "<A> <beta> <D> .", "<B> <beta> <B> ."], 4, 5, 13, 16, 0.954637),
    "two": (["<A> <beta> <B> .", "<B> <beta> <A> ."], 2, 2, 4, 6, 0.999998),
}


@pytest.fixture(scope="module")
def build(spark, tmp_path_factory):
    made = {}

    def run(name, remove_literals=True):
        if (name, remove_literals) not in made:
            path = tmp_path_factory.mktemp("nt") / f"{name}.nt"
            path.write_text("\n".join(GRAPHS[name][0]))
            made[name, remove_literals] = CoOccurrence(text.read_ntriples(spark, str(path)), w.uniform, remove_literals, w.uniform)
        return made[name, remove_literals]

    return run


def matrix(df):
    return {(r.src, r.ctx): r.val for r in df.collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_counts(build, name):
    _, nodes, edges, plain, full, total = GRAPHS[name]
    c = build(name)
    assert (c.graph.nodes.count(), c.graph.edges.count()) == (nodes, edges)
    m = matrix(c.vectors(0.7, 1e-5, edges=False))
    assert len(m) == plain
    assert sum(v for (s, _), v in m.items() if s == 0) == pytest.approx(total, abs=1e-5)
    assert c.vectors(0.7, 1e-5).count() == full


def test_matrix(build):
    m = matrix(build("exit").vectors(0.7, 1e-5))
    want = {0: [0.709579, 0.212873, 0.063862, 0.009578, 0.125595, 0.106437, 0.063862], 1: [0.031931, 0.709579, 0.212874, 0.031931, 0.068652, 0.00479, 0.212874], 2: [0.106437, 0.031931, 0.709579, 0.106437, 0.228839, 0.015965, 0.009579]}
    for s, row in want.items():
        assert [m[s, k] for k in range(7)] == pytest.approx(row, abs=1e-5)
    assert {k: v for k, v in m.items() if k[0] == 3} == {(3, 3): 0.7}


def test_kept_literals(build):
    c = build("literals", False)
    labels = [r.label for r in c.graph.nodes.orderBy("id").collect()]
    assert labels == ["<A>", "<B>", "<C>", '"jeee"', '"12.3"^<xsd:string>']
    m = matrix(c.vectors(0.7, 1e-5))
    assert [m[0, k] for k in range(8)] == pytest.approx([0.7, 0.14, 0.042, 0.0126, 0.07, 0.0826, 0.14, 0.042], abs=1e-6)


def test_closed_form(build):
    m = matrix(build("two").vectors(0.7, 1e-12, edges=False))
    assert m[0, 0] == pytest.approx(0.7 / (1 - 0.09), abs=1e-9)


def test_entities(build):
    assert sorted({s for s, _ in matrix(build("things").vectors(0.7, 1e-5, only_entities=True))}) == [0, 1, 4]
    assert build("things").vectors(0.7, 1e-5, only_entities=True).count() == 21
    assert build("pairs").vectors(0.7, 1e-5, only_entities=True).count() == 30
    assert build("exit").vectors(0.7, 1e-5, only_entities=True).count() == 0


def test_two_way(build):
    c = build("exit")
    row = lambda df: [round(matrix(df).get((0, k), -1), 6) for k in range(7)]
    assert row(c.two_way(0.3, 1e-5)) == pytest.approx([0.81872, 0.477212, 0.497062, 0.062099, 0.648878, 0.205044, 0.401171], abs=2e-5)
    assert row(c.two_way(0.3, 1e-5, normalize=True)) == pytest.approx([-1, 0.208256, 0.216919, 0.0271, 0.283172, 0.089482, 0.175072], abs=2e-5)
    assert row(c.two_way(0.3, 1e-5, compat_backward_only=True)) == pytest.approx([0.45662, 0.223743, 0.319634, -1, 0.397944, 0.07831, 0.223743], abs=2e-5)
    assert row(c.two_way(0.3, 1e-5, normalize=True, compat_backward_only=True)) == pytest.approx([-1, 0.223743, 0.319634, -1, 0.397944, 0.07831, 0.223743], abs=2e-5)


@pytest.mark.parametrize("name", ["exit", "self", "pairs"])
def test_relational_and_compat_agree_with_kernel(build, name):
    c = build(name)
    for preds in (None, c.preds):
        a = matrix(push(c.sources(False), c.forward, 0.7, 1e-5, preds))
        b = matrix(push(c.sources(False), c.forward, 0.7, 1e-5, preds, kernel_edges=0))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-15) for k in a)
        for cached in (False, True):
            m = matrix(compat.vectors(c.graph.nodes, c.forward, c.preds, 0.7, 1e-5, preds is not None, cached))
            assert a.keys() == m.keys() and all(a[k] == pytest.approx(m[k], abs=1e-5) for k in a)


WEIGHTS = {
    "UniformWeigher": [0.333333, 0.333333, 0.333333, 0.5, 0.5, 0.333333, 0.333333, 0.333333],
    "PredicateFrequencyWeigher": [0.375, 0.125, 0.5, 0.2, 0.8, 0.3, 0.3, 0.4],
    "InversePredicateFrequencyWeigher": [0.210526, 0.631579, 0.157895, 0.8, 0.2, 0.363636, 0.363636, 0.272727],
    "ObjectFrequencyWeigher": [0.25, 0.25, 0.5, 0.2, 0.8, 0.166667, 0.166667, 0.666667],
    "InverseObjectFrequencyWeigher": [0.4, 0.4, 0.2, 0.8, 0.2, 0.444444, 0.444444, 0.111111],
    "InverseObjectFrequencyWeigherSplitDown": [0.444444, 0.444444, 0.111111, 0.941176, 0.058824, 0.484848, 0.484848, 0.030303],
    "PredicateObjectFrequencyWeigher": [0.166667, 0.166667, 0.666667, 0.2, 0.8, 0.166667, 0.166667, 0.666667],
    "InversePredicateObjectFrequencyWeigher": [0.444444, 0.444444, 0.111111, 0.8, 0.2, 0.444444, 0.444444, 0.111111],
}


def in_order(edges):
    rows = edges.collect()
    kinds = ["<beta>", "<gamma>", "<delta>", TYPE]
    return [r.weight for r in sorted(rows, key=lambda r: (r.src, kinds.index(r.p), r.dst)) if r.src != 3]


@pytest.mark.parametrize("name", WEIGHTS)
def test_weighers(build, name):
    assert in_order(w.WEIGHERS[name](build("pairs").graph.edges)) == pytest.approx(WEIGHTS[name], abs=1e-6)


def test_rank_weighers(build, spark, tmp_path):
    c = build("pairs")
    (tmp_path / "r.tsv").write_text("A\t0.5\nC\t9\n   \nC\t0.3\textra\n#Q\tx\nZ\t0.5\n")
    ranks = text.read_ranks(spark, str(tmp_path / "r.tsv"))
    assert {r.label: r.w for r in ranks.collect()} == {"<A>": 0.5, "<C>": 0.3, "<Z>": 0.5}
    third = [1 / 3] * 3
    assert in_order(w.push_down_map(ranks, c.graph.nodes, 0.2)(c.graph.edges)) == pytest.approx([*third, 0.6, 0.4, 0.555556, 0.222222, 0.222222], abs=1e-6)
    assert in_order(w.push_down_map(ranks, c.graph.nodes, 0.2, True)(c.graph.edges)) == pytest.approx([*third, 0.5, 0.5, *third], abs=1e-6)
    dense = c.graph.nodes.select("id", (F.col("id") + 1).cast("double").alias("w"))
    assert in_order(w.push_down(dense)(c.graph.edges)) == pytest.approx([2 / 9, 2 / 9, 5 / 9, 3 / 8, 5 / 8, 0.1, 0.4, 0.5])
    into = {0: 1, 1: 2, 2: 1, 3: 1, 4: 4}
    raw = [2 / into[1], 2 / into[1], 5 / into[4], 3, 5 / 4, 1, 4, 5 / 4]
    sums = [sum(raw[:3])] * 3 + [sum(raw[3:5])] * 2 + [sum(raw[5:])] * 3
    assert in_order(w.split_down(dense)(c.graph.edges)) == pytest.approx([a / b for a, b in zip(raw, sums)])


def test_reverse_simple_degrees(build):
    c = build("self")
    e = c.graph.edges
    assert sorted(map(tuple, g.reverse(g.reverse(e)).collect())) == sorted(map(tuple, e.collect()))
    assert {tuple(r) for r in g.simple(e).collect()} == {(0, 1), (1, 2), (2, 0), (0, 3)}
    assert {tuple(r) for r in g.degrees(c.graph.nodes, e).collect()} == {(0, 1, 2), (1, 1, 1), (2, 1, 1), (3, 1, 0)}


@pytest.mark.parametrize("kernel", [0, 10**6])
def test_order(build, spark, kernel, tmp_path):
    for name in ("parallel", "exit", "self", "two"):
        c = build(name)
        order = o.compute_order(c.graph.nodes, c.graph.edges, kernel)
        assert o.is_permutation(order, c.graph.nodes.count())
    pos = {r.id: r.pos for r in o.compute_order(build("parallel").graph.nodes, build("parallel").graph.edges, kernel).collect()}
    assert pos[2] < pos[1] < pos[0]
    assert {r.id: r.level for r in o.levels(build("parallel").graph.nodes, build("parallel").graph.edges).collect()} == {0: 2, 1: 1, 2: 0}
    text.write_order(order, str(tmp_path / "order"))
    assert [tuple(r) for r in text.read_order(spark, str(tmp_path / "order"), 2).orderBy("pos").collect()] == [tuple(r) for r in order.orderBy("pos").collect()]
    with pytest.raises(ValueError):
        text.read_order(spark, str(tmp_path / "order"), 3)


def test_empty_graph(spark):
    c = CoOccurrence(spark.createDataFrame([], "ord bigint, s string, p string, o string"), w.uniform, True, w.uniform)
    assert c.vectors(0.7, 1e-5).count() == 0 and c.two_way(0.7, 1e-5).count() == 0
    assert o.compute_order(c.graph.nodes, c.graph.edges).count() == 0 and c.vocabulary(True).count() == 0


def test_bounds(build):
    assert level_bound(0.7, 1e-5) == 11 and level_bound(0.1, 1e-5) == 111
    for alpha, eps in ((0, 1e-5), (1.1, 1e-5), (0.5, 0)):
        with pytest.raises(ValueError):
            build("one").vectors(alpha, eps)
