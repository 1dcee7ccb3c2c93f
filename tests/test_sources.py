"""Parsing, text and binary formats, names, parameters and runs."""

import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triplewalk.functions import ntriples as nt
from triplewalk.functions.weighers import WEIGHERS, uniform
from triplewalk.operators import graph as g
from triplewalk.operators import vectors as v
from triplewalk.plans import runs
from triplewalk.sources import crec, names, text


def parsed(spark, lines, compat):
    df = spark.createDataFrame(list(enumerate(lines)), "ord bigint, value string")
    return [(r.s, r.p, r.o) for r in text.parse_triples(df, compat).orderBy("ord").collect()]


def test_lines(spark):
    lines = ['_:b1 <p> "Test" .', "<a> <p> _:b2 .", '<a> <p> "x".', '<a> <p> "x"@en .', "<a> <p> <b> . # <c>", "# no", "  "]
    strict = [("_:b1", "<p>", '"Test"'), ("<a>", "<p>", "_:b2"), ("<a>", "<p>", '"x"'), ("<a>", "<p>", '"x"@en'), ("<a>", "<p>", "<b>")]
    assert parsed(spark, lines, False) == strict
    assert parsed(spark, lines, True) == [*strict[:2], ("<a>", "<p>", '"x'), strict[3], ("<a>", "<p>", "<b> . # <c>")]


@pytest.mark.parametrize("line", ["<a> <p> 12 .", " # text", "<a> <p>", "nothing", "<a> <p>\t<b> ."])
def test_malformed_lines(spark, line):
    df = spark.createDataFrame([(0, "<a> <p> <b> ."), (1, line)], "ord bigint, value string")
    with pytest.raises(Exception, match="malformed"):
        text.parse_triples(df).collect()
    assert text.parse_triples(df, mode="PERMISSIVE").count() == 1
    assert [r.value for r in text.malformed(df).collect()] == [line]


def test_literal_trim_against_a_loop(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice('ab". ') for _ in range(rng.randrange(1, 9))) for _ in range(2000)]

    def loop(t):
        while t and t[-1] in " ." and len(t) > 1:
            t = t[:-2]
        return t

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nt.literal(F.col("t"), True)).collect()]
    assert all(a == b for a, b, t in zip(got, map(loop, texts), texts) if t not in (" ", "."))


def test_order_of_lines_over_splits(spark, tmp_path):
    (tmp_path / "g.nt").write_text("".join(f"<n{i}> <p> <n{i + 1}> .\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        triples = text.read_ntriples(spark, str(tmp_path / "g.nt"))
        assert triples.rdd.getNumPartitions() > 2
        ids = {r.label: r.id for r in g.node_ids(triples).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ids == {f"<n{i}>": i for i in range(5001)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABCD"), st.sampled_from("pq"), st.sampled_from("ABCDE")), min_size=1, max_size=10), st.randoms())
def test_properties(spark, triples, rng):
    def build(ts):
        df = spark.createDataFrame([(i, f"<{s}>", f"<{p}>", f"<{o}>") for i, (s, p, o) in enumerate(ts)], "ord bigint, s string, p string, o string")
        graph = g.encode(df)
        from triplewalk.operators.ppr import push

        edges = uniform(graph.edges)
        label = {r.id: r.label for r in graph.nodes.collect()}
        weights = edges.groupBy("src").agg(F.sum("weight").alias("w")).collect()
        assert all(abs(r.w - 1) < 1e-12 for r in weights)
        return {(label[r.src], label[r.ctx]): r.val for r in push(graph.nodes.select(F.col("id").alias("src")), edges, 0.6, 1e-4).collect()}

    one = build(triples)
    shuffled = [*triples, *triples[:3]]
    rng.shuffle(shuffled)
    two = build(shuffled)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    sums = {}
    for (s, _), x in one.items():
        sums[s] = sums.get(s, 0) + x
    assert all(x <= 1 + 1e-9 for x in sums.values())


def test_vectors(spark):
    a = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25), (1, 1, 1.0), (2, 0, 0.0)], "src bigint, ctx bigint, val double")
    assert {tuple(r) for r in v.add(a, a).collect()} == {(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.5), (1, 1, 2.0), (2, 0, 0.0)}
    assert {tuple(r) for r in v.normalize(v.remove_focus(a)).collect()} == {(0, 1, 0.5), (0, 2, 0.5)}
    names_ = spark.createDataFrame([(0, "<a>"), (1, "<b>"), (2, "<c>")], "id bigint, label string")
    assert v.labelled(a, names_).filter("src = 0").first().text == '[{"label":"<a>","id":0,"val":0.5},{"label":"<b>","id":1,"val":0.25},{"label":"<c>","id":2,"val":0.25}]'


def test_record():
    assert crec.decode(b"\x03\x00\x00\x00\x02\x00\x00\x00ffffff\xe6?") == [(3, 2, 0.7)]
    with pytest.raises(ValueError):
        crec.decode(b"\x00" * 17)


def test_records_round_trip(spark, tmp_path):
    rows = [(k % 7 + 1, k + 1, k / 3) for k in range(500)] + [(1, 1, 0.0)]
    df = spark.createDataFrame(rows, crec.SCHEMA).repartition(3)
    path = str(tmp_path / "m.bin")
    for _ in range(2):
        crec.write_cooc(df, path)
    files = [os.path.join(path, f) for f in os.listdir(path)]
    assert sum(map(os.path.getsize, files)) == 16 * len(rows) and all(os.path.basename(f).startswith("part-") for f in files)
    assert sorted(map(tuple, crec.read_cooc(spark, path).collect())) == sorted(rows)
    one = tmp_path / "one.bin"
    one.write_bytes(b"".join(struct.pack("<iid", *r) for r in rows))
    assert [tuple(r) for r in crec.read_cooc(spark, str(one)).collect()] == rows
    assert crec.compressed(crec.read_cooc(spark, str(one))).filter("word1 = 1 and word2 = 1").collect()[0].val == 0.0
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="within a record"):
        crec.read_cooc(spark, str(tmp_path / "bad.bin")).collect()
    with pytest.raises(Exception):
        crec.records(spark.createDataFrame([(2**31, 0, 1.0)], "src bigint, ctx bigint, val double")).collect()


def test_vocabulary_round_trip(spark, tmp_path):
    rows = [(k + 1, f'"label {k}"' if k % 3 else f"<n{k}>") for k in range(40)]
    text.write_vocabulary(spark.createDataFrame(rows, "glove_id int, label string").repartition(4), str(tmp_path / "v"))
    assert sorted(map(tuple, text.read_vocabulary(spark, str(tmp_path / "v")).collect())) == rows


def test_names():
    assert names.matrix_name("output", "a/b.nt", False, "UniformWeigher", 0.7, 1e-5, False, True) == "output/glove_input_file-a_b_nt-no_literals-forwardWeigher_UniformWeigher-alpha_0.69999999999999996-eps_1.0000000000000001e-05-onlyEntities_no-edges_yes.bin"
    assert names.vocabulary_name("output/", "a/b.nt", True) == "output/glove_vocab_with_edges_a_b_nt.txt"
    assert names.two_way_vocabulary_name("o/", "b.nt") == "o/glove_vocab_file_b-nt.txt"


def test_parameters():
    assert len(runs.experiments("g").runs()) == 10
    for bad in ({"alphas": []}, {"alphas": [0.0]}, {"epss": [0]}, {"only_entities": [True, True]}, {"include_edges": []}, {"weighers": []}):
        with pytest.raises(ValueError):
            runs.Parameters([("g", True, True)], **bad).runs()
    with pytest.raises(ValueError):
        runs.two_way_run("a/b").runs()


def test_runs_write_what_they_say(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<A> <b> <B> .\n<B> <b> <A> .\n<B> <c> <A> .\n")
    p = runs.Parameters([("g.nt", True, True)], [(n, WEIGHERS[n]) for n in ("UniformWeigher", "ObjectFrequencyWeigher")], include_edges=[True, False])
    written = runs.parametrized_run(spark, str(tmp_path), p, str(tmp_path / "out"))
    assert len(written) == 6 and all(os.path.isdir(w) for w in written)
    assert crec.read_cooc(spark, written[2]).count() == 8 and text.read_vocabulary(spark, written[0]).count() == 4
    two = runs.parametrized_two_way_run(spark, str(tmp_path), runs.two_way_run("g.nt"), str(tmp_path / "two"))
    sums = crec.read_cooc(spark, two[1]).groupBy("word1").agg(F.sum("val").alias("v")).collect()
    assert all(r.v == pytest.approx(1) for r in sums)


def test_stream(spark, tmp_path):
    from triplewalk.streaming import stream_ntriples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<a> <p> "x" .\n# no\nbroken\n<a> <p> <b> .\n')
    q = stream_ntriples(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("triples").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("triples").collect()} == {("<a>", "<p>", '"x"'), ("<a>", "<p>", "<b>")}


def test_matrices_of_records(spark):
    cooc = spark.createDataFrame([(2, 1, 0.5), (1, 1, 0.25), (2, 1, 0.5), (1, 3, 1.0)], "word1 int, word2 int, val double")
    row, col, val, shape = crec.coo(cooc)
    assert shape == (3, 4) and sorted(zip(row.tolist(), col.tolist(), val.tolist())) == [(1, 1, 0.25), (1, 3, 1.0), (2, 1, 0.5), (2, 1, 0.5)]
    first, rows, values, shape = crec.csc(cooc)
    assert (first.tolist(), rows.tolist(), values.tolist(), shape) == ([0, 0, 2, 2, 3], [1, 2, 1], [0.25, 1.0, 1.0], (3, 4))
    assert [tuple(r) for r in crec.columns(cooc).orderBy("slot").collect()] == [(0, 1, 1, 0.25), (1, 2, 1, 1.0), (2, 1, 3, 1.0)]
    assert crec.csc(cooc.limit(0))[0].tolist() == [0]
