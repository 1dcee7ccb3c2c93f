"""Queries over the driver's tables, which become a graph by SQL that Spark and the oracle share, and the oracle's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import weighers as w
from ..functions.ntriples import OWL_THING, RDF_TYPE
from ..operators import graph as g
from ..operators import order as o
from ..lineage import shared_folder
from ..operators.cooc import CoOccurrence, for_grid
from ..operators.ppr import cached, push, push_both, push_normalized, walks
from ..sources import crec, names, text
from . import runs

TABLES = "region nation customer supplier part orders lineitem events".split()
ALPHA, EPS = 0.7, 1.234e-5

BLOCKS = {
    "customers": "select cast(0 as bigint) * 1000000000000000 + c_custkey * 1000000 as ord, '<c/' || cast(c_custkey as string) || '>' as s, '<inNation>' as p, '<n/' || cast(c_nationkey as string) || '>' as o from {customer}",
    "suppliers": "select cast(1 as bigint) * 1000000000000000 + s_suppkey * 1000000 as ord, '<s/' || cast(s_suppkey as string) || '>' as s, '<inNation>' as p, '<n/' || cast(s_nationkey as string) || '>' as o from {supplier}",
    "nations": "select cast(2 as bigint) * 1000000000000000 + n_nationkey * 1000000 as ord, '<n/' || cast(n_nationkey as string) || '>' as s, '<inRegion>' as p, '<r/' || cast(n_regionkey as string) || '>' as o from {nation}",
    "parts": "select distinct cast(3 as bigint) * 1000000000000000 + l_partkey * 1000000 + l_suppkey as ord, '<p/' || cast(l_partkey as string) || '>' as s, '<suppliedBy>' as p, '<s/' || cast(l_suppkey as string) || '>' as o from {lineitem}",
    "orders": "select cast(4 as bigint) * 1000000000000000 + o_orderkey * 1000000 as ord, '<o/' || cast(o_orderkey as string) || '>' as s, '<placedBy>' as p, '<c/' || cast(o_custkey as string) || '>' as o from {orders}",
    "events": "select cast(5 as bigint) * 1000000000000000 + user_id * 1000000 + rank as ord, '<u/' || cast(user_id as string) || '>' as s, '<did>' as p, '<e/' || e.event_type || '>' as o from (select distinct user_id, event_type from {events}) e join (select event_type, row_number() over (order by event_type) as rank from (select distinct event_type from {events}) k) r on r.event_type = e.event_type",
    "names": "select cast(6 as bigint) * 1000000000000000 + s_suppkey * 1000000 as ord, '<s/' || cast(s_suppkey as string) || '>' as s, '<name>' as p, '\"' || s_name || '\"' as o from {supplier}",
    "things": f"select cast(7 as bigint) * 1000000000000000 + s_suppkey * 1000000 as ord, '<s/' || cast(s_suppkey as string) || '>' as s, '{RDF_TYPE}' as p, '{OWL_THING}' as o from {{supplier}} where s_suppkey % 3 = 0",
    "back": "select cast(8 as bigint) * 1000000000000000 + s_suppkey * 1000000 as ord, '<n/' || cast(s_nationkey as string) || '>' as s, '<hosts>' as p, '<s/' || cast(s_suppkey as string) || '>' as o from {supplier}",
    "regions": "select cast(9 as bigint) * 1000000000000000 + n_nationkey * 1000000 as ord, '<r/' || cast(n_regionkey as string) || '>' as s, '<holds>' as p, '<n/' || cast(n_nationkey as string) || '>' as o from {nation}",
    "again": "select cast(10 as bigint) * 1000000000000000 + s_suppkey * 1000000 as ord, '<s/' || cast(s_suppkey as string) || '>' as s, '<inNation>' as p, '<n/' || cast(s_nationkey as string) || '>' as o from {supplier}",
    "selves": "select cast(11 as bigint) * 1000000000000000 + n_nationkey * 1000000 as ord, '<n/' || cast(n_nationkey as string) || '>' as s, '<near>' as p, '<n/' || cast(n_nationkey as string) || '>' as o from {nation}",
}
ALL = ("customers", "suppliers", "nations", "parts", "orders", "events", "names", "things", "again", "selves")
DAG = ("customers", "suppliers", "nations", "parts")
CYCLIC = ("suppliers", "nations", "back", "regions")
TYPED = (*CYCLIC, "things")


def union(blocks: tuple[str, ...]) -> str:
    return " union all ".join(BLOCKS[b] for b in blocks)


def oracle_triples(blocks: tuple[str, ...]) -> str:
    return union(blocks).format(**{t: t for t in TABLES})


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in query}
    return spark.sql(query, **used)


def triples(spark: SparkSession, sf_dir: str, blocks: tuple[str, ...]) -> DataFrame:
    return sql(spark, sf_dir, union(blocks))


def encoded(spark: SparkSession, sf_dir: str, blocks: tuple[str, ...], weigher: w.Weigher = w.uniform) -> tuple[g.Graph, DataFrame]:
    graph = g.encode(g.drop_literals(triples(spark, sf_dir, blocks)))
    return graph, weigher(graph.edges)


def nano(column: Column) -> Column:
    return F.floor(column * 1e9 + 0.123).cast("bigint")


def quantised(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    return df.select(*keep, nano(F.col(column)).alias(name))


# Parsing and graph construction


def lines_of(df: DataFrame) -> DataFrame:
    return df.select("ord", F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def triples_parse(spark, sf_dir):
    return text.parse_triples(lines_of(triples(spark, sf_dir, ALL)))


QUIRKS = """
select cast(n_nationkey as bigint) * 10 + k as ord, case k
 when 0 then '_:b' || cast(n_nationkey as string) || ' <p> "' || n_name || '" .'
 when 1 then '<n/' || cast(n_nationkey as string) || '> <p> _:b' || cast(n_regionkey as string) || ' .'
 when 2 then '<n/' || cast(n_nationkey as string) || '> <p>   "' || n_name || '".'
 when 3 then '<n/' || cast(n_nationkey as string) || '> <p> "' || n_name || '"@en .'
 when 4 then '<n/' || cast(n_nationkey as string) || '> <p> <r/' || cast(n_regionkey as string) || '> . # <c>'
 when 5 then '# comment' when 6 then '   ' else '<n/' || cast(n_nationkey as string) || '><p><r/1>.' end as value
from {nation} cross join (select explode(sequence(0, 7)) as k) q
"""


def triples_parse_quirks(spark, sf_dir):
    lines = sql(spark, sf_dir, QUIRKS)
    forms = [text.parse_triples(lines, compat).select(F.lit(compat).alias("compat"), "ord", "s", "p", "o") for compat in (False, True)]
    return forms[0].unionByName(forms[1])


QUIRKS_SQL = """
with n as (select *, '<n/' || n_nationkey || '>' as s, '"' || n_name || '"' as q, '<r/' || n_regionkey || '>' as r from nation), c as (select unnest([false, true]) as compat)
select compat, n_nationkey::bigint * 10 as ord, '_:b' || n_nationkey as s, '<p>' as p, q as o from n, c
union all select compat, n_nationkey::bigint * 10 + 1, s, '<p>', '_:b' || n_regionkey from n, c
union all select compat, n_nationkey::bigint * 10 + 2, s, '<p>', case when compat then '"' || n_name else q end from n, c
union all select compat, n_nationkey::bigint * 10 + 3, s, '<p>', q || '@en' from n, c
union all select compat, n_nationkey::bigint * 10 + 4, s, '<p>', case when compat then r || ' . # <c>' else r end from n, c
union all select compat, n_nationkey::bigint * 10 + 7, s, '<p>', '<r/1>' from n, c
"""


def literal_filter(spark, sf_dir):
    return g.drop_literals(triples(spark, sf_dir, ALL))


def triple_dedup(spark, sf_dir):
    return g.dedup(triples(spark, sf_dir, ALL))


def node_ids(spark, sf_dir):
    return g.node_ids(g.drop_literals(triples(spark, sf_dir, ALL)))


def predicate_ids(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, ALL)
    return g.predicate_ids(graph.edges, graph.nodes.count())


def edge_order(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, DAG)
    from pyspark.sql import Window

    return graph.edges.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("eord")) - 1).cast("bigint").alias("k"), "p", "dst")


def in_out_degree(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, ALL)
    return g.degrees(graph.nodes, graph.edges)


def simple_graph(spark, sf_dir):
    return g.simple(encoded(spark, sf_dir, ALL)[0].edges)


def reverse_graph(spark, sf_dir):
    return g.reverse(encoded(spark, sf_dir, DAG)[0].edges).select("src", "p", "dst")


def is_entity(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, TYPED)
    return g.entities(graph).join(graph.nodes, "id").select("id", "label")


def vocab_no_edges(spark, sf_dir):
    return g.vocabulary(encoded(spark, sf_dir, TYPED)[0].nodes)


def vocab_with_edges(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, TYPED)
    return g.vocabulary(graph.nodes, g.predicate_ids(graph.edges, graph.nodes.count()))


# Weighers


def weigh(weigher: Callable[[SparkSession, str, g.Graph], w.Weigher]):
    def query(spark, sf_dir):
        graph = g.encode(g.drop_literals(triples(spark, sf_dir, ALL)))
        return quantised(weigher(spark, sf_dir, graph)(graph.edges), "weight", "q", "src", "p", "dst")

    return query


SCHEMES = {
    "weigh_uniform": ("UniformWeigher", "1.0"),
    "weigh_pred_freq": ("PredicateFrequencyWeigher", "count(*) over (partition by p)"),
    "weigh_inv_pred_freq": ("InversePredicateFrequencyWeigher", "1.0::double / count(*) over (partition by p)"),
    "weigh_obj_freq": ("ObjectFrequencyWeigher", "count(*) over (partition by dst)"),
    "weigh_inv_obj_freq": ("InverseObjectFrequencyWeigher", "1.0::double / count(*) over (partition by dst)"),
    "weigh_inv_obj_freq_split": ("InverseObjectFrequencyWeigherSplitDown", "1.0::double / count(*) over (partition by dst) / count(*) over (partition by dst)"),
    "weigh_pred_obj_freq": ("PredicateObjectFrequencyWeigher", "count(*) over (partition by p, dst)"),
    "weigh_inv_pred_obj_freq": ("InversePredicateObjectFrequencyWeigher", "1.0::double / count(*) over (partition by p, dst)"),
}


def dense(spark, sf_dir, graph):
    return graph.nodes.select("id", (F.col("id") % 7 + 1).cast("double").alias("w"))


RANKS = "select '<s/' || cast(s_suppkey as string) || '>' as label, abs(s_acctbal) + 1.0 as w from {supplier}"


def weigh_push_down_map(spark, sf_dir, graph):
    return w.push_down_map(sql(spark, sf_dir, RANKS), graph.nodes, 0.2)


# Walks


def bca_dag(spark, sf_dir):
    graph, edges = encoded(spark, sf_dir, DAG)
    return quantised(push(graph.nodes.select(F.col("id").alias("src")), edges, ALPHA, EPS), "val", "q", "src", "ctx")


def _cyclic(spark, sf_dir, blocks=TYPED, weigher=w.uniform):
    graph, edges = encoded(spark, sf_dir, blocks, weigher)
    preds = g.predicate_ids(graph.edges, graph.nodes.count())
    return graph, edges, preds, graph.nodes.select(F.col("id").alias("src"))


def bca_cyclic(spark, sf_dir):
    graph, edges, _, sources = _cyclic(spark, sf_dir, CYCLIC)
    return quantised(push(sources, edges, ALPHA, EPS), "val", "q", "src", "ctx")


def bca_cyclic_relational(spark, sf_dir):
    """The same by joins and aggregations alone, as for graphs that no task can hold."""
    graph, edges, _, sources = _cyclic(spark, sf_dir, CYCLIC)
    return quantised(push(sources, edges, ALPHA, EPS, kernel_edges=0), "val", "q", "src", "ctx")


def bca_with_edges(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    return quantised(push(sources, edges, ALPHA, EPS, preds), "val", "q", "src", "ctx")


def cooc_only_entities(spark, sf_dir):
    graph, edges, preds, _ = _cyclic(spark, sf_dir)
    focus = g.entities(graph).select(F.col("id").alias("src"))
    return quantised(crec.records(push(focus, edges, ALPHA, EPS, preds)), "val", "q", "word1", "word2")


def cooc_normalized(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    return quantised(crec.records(push_normalized(sources, edges, ALPHA, EPS, preds)), "val", "q", "word1", "word2")


def _two_way(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    back = w.uniform(g.reverse(graph.edges))
    return push_both(sources, edges, back, 0.3, EPS, preds)


def bcv_add_fwd_rev(spark, sf_dir):
    return quantised(_two_way(spark, sf_dir).rows(), "val", "q", "src", "ctx")


def bcv_remove_normalize(spark, sf_dir):
    return quantised(_two_way(spark, sf_dir).scaled(), "val", "q", "src", "ctx")


GRID = [(a, EPS) for a in (0.3, 0.7)]
GRID_WEIGHERS = ("UniformWeigher", "InversePredicateFrequencyWeigher")


def param_grid(spark, sf_dir):
    graph, _, _, sources = _cyclic(spark, sf_dir, CYCLIC)
    runs = for_grid(sources, {n: w.WEIGHERS[n](graph.edges) for n in GRID_WEIGHERS}, GRID)
    return quantised(runs, "val", "q", "weigher", "alpha", "src", "ctx")


def param_grid_relational(spark, sf_dir):
    """The same by joins and aggregations alone, all runs in one frontier, and with predicates."""
    graph, _, preds, sources = _cyclic(spark, sf_dir, CYCLIC)
    runs = for_grid(sources, {n: w.WEIGHERS[n](graph.edges) for n in GRID_WEIGHERS}, GRID, preds, kernel_edges=0)
    return quantised(runs, "val", "q", "weigher", "alpha", "src", "ctx")


def bca_cached(spark, sf_dir):
    graph, edges = encoded(spark, sf_dir, DAG)
    return quantised(cached(graph.nodes, edges, ALPHA, EPS), "val", "q", "src", "ctx")


def bca_cached_with_edges(spark, sf_dir):
    graph, edges, preds, _ = _cyclic(spark, sf_dir, DAG)
    return quantised(cached(graph.nodes, edges, ALPHA, EPS, preds), "val", "q", "src", "ctx")


def bca_with_edges_relational(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    return quantised(push(sources, edges, ALPHA, EPS, preds, kernel_edges=0), "val", "q", "src", "ctx")


def weigh_each_edge(spark, sf_dir):
    """A scheme of one's own, by an expression over the edge."""
    graph, _ = encoded(spark, sf_dir, ALL)
    return quantised(w.for_each_edge(graph.edges, (F.col("src") % 5 + 1) / (F.col("dst") % 3 + 2)), "weight", "q", "src", "p", "dst")


def bcv_add_above(spark, sf_dir):
    return quantised(_two_way(spark, sf_dir).above(0.01).rows(), "val", "q", "src", "ctx")


def bcv_labelled(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    return walks(sources, [edges], [(ALPHA, EPS)], preds)[0].labelled(graph.nodes.unionByName(preds), nano)


def _computer(spark, sf_dir, weigher=w.uniform, **kw):
    return CoOccurrence(triples(spark, sf_dir, TYPED), weigher, **kw)


def computer_with_edges(spark, sf_dir):
    return quantised(crec.records(_computer(spark, sf_dir).vectors(ALPHA, EPS)), "val", "q", "word1", "word2")


def computer_no_edges_entities(spark, sf_dir):
    return quantised(crec.records(_computer(spark, sf_dir).vectors(ALPHA, EPS, edges=False, only_entities=True)), "val", "q", "word1", "word2")


def computer_no_edges_normalized(spark, sf_dir):
    return quantised(crec.records(_computer(spark, sf_dir).vectors(ALPHA, EPS, edges=False, normalize=True)), "val", "q", "word1", "word2")


def computer_reweighed(spark, sf_dir):
    """Weighed anew after construction."""
    return quantised(crec.records(_computer(spark, sf_dir).reweigh(w.WEIGHERS["InversePredicateFrequencyWeigher"]).vectors(ALPHA, EPS, edges=False)), "val", "q", "word1", "word2")


def computer_two_way_normalized(spark, sf_dir):
    return quantised(_computer(spark, sf_dir, backward=w.uniform).two_way(0.3, EPS, normalize=True), "val", "q", "src", "ctx")


def computer_backward_only(spark, sf_dir):
    """The reverse walk alone, as the compat flag has it."""
    return quantised(_computer(spark, sf_dir, backward=w.uniform).two_way(0.3, EPS, compat_backward_only=True), "val", "q", "src", "ctx")


# Order, ranks, records


def topo_levels(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, DAG)
    return o.levels(graph.nodes, graph.edges)


def compute_order(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, CYCLIC)
    return o.compute_order(graph.nodes, graph.edges)


def compute_order_relational(spark, sf_dir):
    graph, _ = encoded(spark, sf_dir, DAG)
    return o.compute_order(graph.nodes, graph.edges, kernel_edges=0)


# Files, in the folder that all executors share


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def order_file(spark, sf_dir):
    """An order written and read again, by a computer that checks that it is one of its nodes."""
    graph, _ = encoded(spark, sf_dir, CYCLIC)
    path = scratch(spark, "order")
    text.write_order(o.compute_order(graph.nodes, graph.edges), path)
    return CoOccurrence(triples(spark, sf_dir, CYCLIC), w.uniform, order=text.read_order(spark, path, graph.nodes.count())).order


def crec_roundtrip(spark, sf_dir):
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    path = scratch(spark, "crec")
    crec.write_cooc(crec.records(push(sources, edges, ALPHA, EPS, preds)), path)
    return quantised(crec.read_cooc(spark, path), "val", "q", "word1", "word2")


def crec_columns(spark, sf_dir):
    """The records of a file, each written twice, as a matrix by columns."""
    graph, edges, preds, sources = _cyclic(spark, sf_dir)
    path = scratch(spark, "crec")
    rows = crec.records(push(sources, edges, ALPHA, EPS, preds))
    crec.write_cooc(rows.unionByName(rows), path)
    return quantised(crec.columns(crec.read_cooc(spark, path)), "val", "q", "slot", "word1", "word2")


def written_triples(spark, sf_dir, blocks) -> str:
    """A folder of N-Triples lines, in order over its files, each of one task, with comments and blank lines."""
    path = scratch(spark, "graph") + ".nt"
    noise = spark.createDataFrame([("# a comment",), ("   ",)], "value string")
    lines_of(triples(spark, sf_dir, blocks)).orderBy("ord").select("value").unionByName(noise.coalesce(1)).write.text(path)
    return path


def triples_file(spark, sf_dir):
    return text.read_ntriples(spark, written_triples(spark, sf_dir, ALL)).select("s", "p", "o")


def triples_file_no_literals(spark, sf_dir):
    return text.read_ntriples_ignore_literals(spark, written_triples(spark, sf_dir, ALL)).select("s", "p", "o")


def vocab_file(spark, sf_dir):
    path = scratch(spark, "vocab")
    text.write_vocabulary(_computer(spark, sf_dir).vocabulary(edges=True), path)
    return text.read_vocabulary(spark, path)


def rank_file(spark, sf_dir):
    path = scratch(spark, "ranks")
    sql(spark, sf_dir, RANK_LINES).orderBy("ord").coalesce(1).select("value").write.text(path)
    return text.read_ranks(spark, path)


def file_to_matrix(spark, sf_dir):
    """From a file of triples to records on disk and back, by the default run; the files' names carry the parameters."""
    path, out = written_triples(spark, sf_dir, TYPED), scratch(spark, "out")
    folder, _, name = path.rpartition("/")
    written = runs.parametrized_run(spark, folder, runs.default_run(name), out)
    return _named(spark, [x for x in written if x.endswith(".bin")], name.replace(".", "_"), out)


def experiment_files(spark, sf_dir):
    """The sweep of ten runs."""
    path, out = written_triples(spark, sf_dir, CYCLIC), scratch(spark, "out")
    folder, _, name = path.rpartition("/")
    written = runs.parametrized_run(spark, folder, runs.experiments(name), out)
    return _named(spark, [x for x in written if x.endswith(".bin")], name.replace(".", "_"), out)


def two_way_files(spark, sf_dir):
    path, out = written_triples(spark, sf_dir, TYPED), scratch(spark, "out")
    folder, _, name = path.rpartition("/")
    written = runs.parametrized_two_way_run(spark, folder, runs.two_way_run(name), out)
    return _named(spark, [x for x in written if x.endswith(".bin")], name.replace(".", "-"), out)


def _named(spark, paths: list[str], graph: str, out: str) -> DataFrame:
    """(name, word1, word2, q) of files of records, the graph's own name left out of theirs."""
    found = None
    for path in paths:
        part = quantised(crec.read_cooc(spark, path).withColumn("name", F.lit(path.removeprefix(out).replace(graph, "g"))), "val", "q", "name", "word1", "word2")
        found = part if found is None else found.unionByName(part)
    return found


def run_names(spark, sf_dir):
    """The file of every run of a grid."""
    p = runs.Parameters([("a/b.nt", True, True)], [(n, w.WEIGHERS[n]) for n in GRID_WEIGHERS], [0.7, 0.1], [1e-5], [False, True], [True, False])
    rows = [(names.matrix_name("out", "a/b.nt", False, r["weigher"][0], r["alpha"], r["eps"], r["only_entities"], r["include_edges"]),) for r in p.runs()]
    return spark.createDataFrame(rows + [(names.vocabulary_name("out/", "a/b.nt", e),) for e in p.include_edges], "name string")


RANK_LINES = "select cast(s_suppkey as bigint) * 4 + k as ord, case k when 0 then 's/' || cast(s_suppkey as string) || chr(9) || '7.5' when 1 then 's/' || cast(s_suppkey as string) || chr(9) || cast(s_suppkey as string) || '.25' || chr(9) || 'more' when 2 then '# note' else '  ' end as value from {supplier} cross join (select explode(sequence(0, 3)) as k) q"


def tsv_rank_map(spark, sf_dir):
    return text.parse_ranks(sql(spark, sf_dir, RANK_LINES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [triples_parse, triples_parse_quirks, literal_filter, triple_dedup, node_ids, predicate_ids, edge_order, in_out_degree, simple_graph, reverse_graph, is_entity, vocab_no_edges, vocab_with_edges]
    walks = [bca_dag, bca_cyclic, bca_cyclic_relational, bca_with_edges, bca_with_edges_relational, bca_cached, bca_cached_with_edges, weigh_each_edge, cooc_only_entities, cooc_normalized, bcv_add_fwd_rev, bcv_remove_normalize, bcv_add_above, bcv_labelled, param_grid, param_grid_relational, topo_levels, compute_order, compute_order_relational]
    walks += [computer_with_edges, computer_no_edges_entities, computer_no_edges_normalized, computer_reweighed, computer_two_way_normalized, computer_backward_only]
    walks += [order_file, crec_roundtrip, crec_columns, triples_file, triples_file_no_literals, vocab_file, rank_file, tsv_rank_map, file_to_matrix, experiment_files, two_way_files, run_names]
    found = {f.__name__: f for f in plain}
    found |= {name: weigh(lambda s, d, graph, n=n: w.WEIGHERS[n]) for name, (n, _) in SCHEMES.items()}
    found |= {"weigh_push_down": weigh(lambda s, d, graph: w.push_down(dense(s, d, graph))), "weigh_push_down_map": weigh(weigh_push_down_map), "weigh_split_down": weigh(lambda s, d, graph: w.split_down(dense(s, d, graph)))}
    return found | {f.__name__: f for f in walks}


# The oracle


def _base(blocks: tuple[str, ...], *more: str, recursive: bool = False) -> str:
    ctes = [
        f"t as ({oracle_triples(blocks)})",
        "d as (select s, p, o, min(ord) as ord from t where o not like '\"%' group by s, p, o)",
        "pos as (select s as label, ord::hugeint * 2 as k from d union all select o, ord::hugeint * 2 + 1 from d)",
        "nodes as (select label, row_number() over (order by min(k)) - 1 as id from pos group by label)",
        "edges as (select a.id as src, d.ord as eord, p, b.id as dst from d join nodes a on a.label = s join nodes b on b.label = o)",
        "preds as (select p as label, (select count(*) from nodes) + row_number() over (order by min(src), min_by(eord, src * 100000000000000000::hugeint + eord)) - 1 as id from edges group by p)",
        "ents as (select distinct src as id from edges join nodes on nodes.id = dst where p = '%s' and label = '%s')" % (RDF_TYPE, OWL_THING),
        *more,
    ]
    return f"with {'recursive ' if recursive else ''}" + ", ".join(ctes) + " "


def _weighted(raw: str, name: str = "we", source: str = "edges") -> str:
    return f"{name} as (select src, p, dst, raw / sum(raw) over (partition by src) as weight from (select *, ({raw})::double as raw from {source}))"


def _walk(name: str, edges: str, alpha: float, eps: float = EPS, start: str = "nodes") -> str:
    return f"{name}(src, node, paint) as (select id, id, 1.0::double from {start} union all select f.src, e.dst, sum(({1 - alpha!r})::double * f.paint * e.weight) from {name} f join {edges} e on e.src = f.node where f.paint >= {eps!r}::double group by 1, 2)"


def _vector(name: str, walk: str, edges: str, alpha: float, with_edges: bool, eps: float = EPS) -> str:
    out = f"select src, node as ctx, {alpha!r}::double * paint as val from {walk}"
    if with_edges:
        out += f" union all select f.src, q.id, ({alpha!r} * {1 - alpha!r})::double * f.paint * e.weight from {walk} f join {edges} e on e.src = f.node join preds q on q.label = e.p where f.paint >= {eps!r}::double"
    return f"{name} as (select src, ctx, sum(val) as val from ({out}) group by 1, 2)"


def _q(column: str) -> str:
    return f"floor({column} * 1e9 + 0.123)::bigint as q"


def oracle_sql() -> dict[str, str]:
    everything = oracle_triples(ALL)
    out = {
        "triples_parse": f"select * from ({everything})",
        "triples_parse_quirks": QUIRKS_SQL,
        "literal_filter": f"select * from ({everything}) where o not like '\"%'",
        "triple_dedup": f"select min(ord) as ord, s, p, o from ({everything}) group by s, p, o",
        "node_ids": _base(ALL) + "select id, label from nodes",
        "predicate_ids": _base(ALL) + "select id, label from preds",
        "edge_order": _base(DAG) + "select src, row_number() over (partition by src order by eord) - 1 as k, p, dst from edges",
        "in_out_degree": _base(ALL, "si as (select distinct src, dst from edges where src <> dst)") + "select id, coalesce(i, 0) as in_degree, coalesce(o, 0) as out_degree from nodes left join (select dst, count(*) as i from si group by dst) on dst = id left join (select src, count(*) as o from si group by src) on src = id",
        "simple_graph": _base(ALL) + "select distinct src, dst from edges where src <> dst",
        "reverse_graph": _base(DAG) + "select dst as src, p, src as dst from edges",
        "is_entity": _base(TYPED) + "select id, label from nodes where id in (select id from ents)",
        "vocab_no_edges": _base(TYPED) + "select (id + 1)::int as glove_id, label from nodes",
        "vocab_with_edges": _base(TYPED) + "select (id + 1)::int as glove_id, label from nodes union all select (id + 1)::int, label from preds",
        "topo_levels": _base(DAG, "l(id, level) as (select id, 0::bigint from nodes where id not in (select src from edges) union select e.src, level + 1 from l join edges e on e.dst = l.id)", recursive=True) + "select id, max(level) as level from l group by id",
        "tsv_rank_map": "select '<s/' || s_suppkey || '>' as label, s_suppkey + 0.25::double as w from supplier",
    }
    ranked = "re as (select edges.*, coalesce(w, 0.2) as w from edges left join (select label, id from nodes) n on n.id = dst left join (select '<s/' || s_suppkey || '>' as label, abs(s_acctbal) + 1.0 as w from supplier) r on r.label = n.label)"
    for name, (_, raw) in SCHEMES.items():
        out[name] = _base(ALL, _weighted(raw)) + f"select src, p, dst, {_q('weight')} from we"
    out["weigh_push_down"] = _base(ALL, _weighted("dst % 7 + 1")) + f"select src, p, dst, {_q('weight')} from we"
    out["weigh_push_down_map"] = _base(ALL, ranked, _weighted("w", source="re")) + f"select src, p, dst, {_q('weight')} from we"
    out["weigh_split_down"] = _base(ALL, _weighted("(dst % 7 + 1)::double / count(*) over (partition by dst)")) + f"select src, p, dst, {_q('weight')} from we"
    u = _weighted("1.0")
    result = f"select src, ctx, {_q('val')} from b"
    words = f"select (src + 1)::int as word1, (ctx + 1)::int as word2, {_q('val')} from b"
    out["bca_dag"] = _base(DAG, u, _walk("f", "we", ALPHA), _vector("b", "f", "we", ALPHA, False), recursive=True) + result
    out["bca_cyclic"] = out["bca_cyclic_relational"] = _base(CYCLIC, u, _walk("f", "we", ALPHA), _vector("b", "f", "we", ALPHA, False), recursive=True) + result
    full = (u, _walk("f", "we", ALPHA), _vector("b0", "f", "we", ALPHA, True))
    out["bca_with_edges"] = _base(TYPED, *full, "b as (select * from b0)", recursive=True) + result
    out["cooc_only_entities"] = _base(TYPED, u, _walk("f", "we", ALPHA, start="ents"), _vector("b", "f", "we", ALPHA, True), recursive=True) + words
    out["cooc_normalized"] = _base(TYPED, *full, "b as (select src, ctx, val / sum(val) over (partition by src) as val from b0 where src <> ctx)", recursive=True) + words
    both = (u, "back as (select dst as src, p, src as dst from edges)", _weighted("1.0", "wb", "back"), _walk("f", "we", 0.3), _walk("h", "wb", 0.3), _vector("v1", "f", "we", 0.3, True), _vector("v2", "h", "wb", 0.3, True), "s as (select src, ctx, sum(val) as val from (select * from v1 union all select * from v2) group by 1, 2)")
    out["bcv_add_fwd_rev"] = _base(TYPED, *both, "b as (select * from s)", recursive=True) + result
    out["bcv_remove_normalize"] = _base(TYPED, *both, "b as (select src, ctx, val / sum(val) over (partition by src) as val from s where src <> ctx)", recursive=True) + result
    inverse = _weighted(SCHEMES["weigh_inv_pred_freq"][1], "wi")
    for query, with_edges in (("param_grid", False), ("param_grid_relational", True)):
        ctes, parts = [u, inverse], []
        for i, name in enumerate(GRID_WEIGHERS):
            for k, (alpha, eps) in enumerate(GRID):
                ctes += [_walk(f"f{i}{k}", ("we", "wi")[i], alpha), _vector(f"b{i}{k}", f"f{i}{k}", ("we", "wi")[i], alpha, with_edges)]
                parts.append(f"select '{name}' as weigher, {alpha!r}::double as alpha, src, ctx, {_q('val')} from b{i}{k}")
        out[query] = _base(CYCLIC, *ctes, recursive=True) + " union all ".join(parts)
    out["bca_with_edges_relational"] = out["bca_with_edges"]
    out["computer_with_edges"] = out["crec_roundtrip"] = _base(TYPED, *full, "b as (select * from b0)", recursive=True) + words
    plain = (u, _walk("f", "we", ALPHA), _vector("b0", "f", "we", ALPHA, False))
    out["computer_no_edges_entities"] = _base(TYPED, *plain, "b as (select * from b0 where src in (select id from ents))", recursive=True) + words
    out["computer_no_edges_normalized"] = _base(TYPED, *plain, "b as (select src, ctx, val / sum(val) over (partition by src) as val from b0 where src <> ctx)", recursive=True) + words
    out["computer_reweighed"] = _base(TYPED, inverse, _walk("f", "wi", ALPHA), _vector("b", "f", "wi", ALPHA, False), recursive=True) + words
    out["computer_two_way_normalized"] = out["bcv_remove_normalize"]
    out["computer_backward_only"] = _base(TYPED, *both, "b as (select * from v2)", recursive=True) + result
    out["bcv_add_above"] = _base(TYPED, *both, "b as (select * from s where val > 0.01)", recursive=True) + result
    out["bcv_labelled"] = _base(TYPED, *full, "names as (select id, label from nodes union all select id, label from preds)", f"v as (select src, label, ctx, {_q('val')} from b0 join names on id = ctx)", recursive=True) + """select src, '[' || string_agg('{"label":' || to_json(label) || ',"id":' || ctx || ',"val":' || q || '}', ',' order by label, ctx, q) || ']' as text from v group by src"""
    out["weigh_each_edge"] = _base(ALL) + f"select src, p, dst, {_q('((src % 5 + 1)::double / (dst % 3 + 2))')} from edges"
    out["crec_columns"] = _base(TYPED, *full, recursive=True) + f"select row_number() over (order by ctx, src) - 1 as slot, (src + 1)::int as word1, (ctx + 1)::int as word2, {_q('(val * 2)')} from b0"
    lv = "l(id, level) as (select id, 0::bigint from nodes where id not in (select src from edges) union select e.src, level + 1 from l join edges e on e.dst = l.id)", "lv as (select id, max(level) as level from l group by id)"
    out["compute_order_relational"] = _base(DAG, *lv, recursive=True) + "select row_number() over (order by level, id) - 1 as pos, id from lv"
    # Turns: state is what has gone. No node left is ready: the busiest goes.
    turns = """si as (select distinct src, dst from edges where src <> dst),
      gone(turn, ids) as (select 0, []::bigint[] union all
        select turn + 1, list_concat(ids, coalesce(
          (select list(id order by id) from nodes where not list_contains(ids, id) and id not in (select src from si where not list_contains(ids, dst))),
          (select [arg_max(dst, (n, -dst))] from (select dst, count(*) as n from si where not list_contains(ids, src) and not list_contains(ids, dst) group by dst))))
        from gone where len(ids) < (select count(*) from nodes))"""
    out["compute_order"] = out["order_file"] = _base(CYCLIC, turns, recursive=True) + "select (generate_subscripts(ids, 1) - 1)::bigint as pos, unnest(ids) as id from gone where len(ids) = (select count(*) from nodes)"
    for query, with_edges in (("bca_cached", False), ("bca_cached_with_edges", True)):
        ctes = [u, *lv, f"flow as (select src, dst, level, sum(({1 - ALPHA!r})::double * weight) as p from we join lv on lv.id = src group by all)"]
        for k in range(4):
            known = " union all ".join(f"select * from m{j}" for j in range(k)) or "select 0 as src, 0 as ctx, 0.0 as val where false"
            crossed = f" union all select src, q.id, {ALPHA!r} * ({1 - ALPHA!r})::double * weight from we join lv on lv.id = src join preds q on q.label = we.p where level = {k}" if with_edges else ""
            ctes.append(f"m{k} as (select src, ctx, sum(val) as val from (select id as src, id as ctx, {ALPHA!r}::double as val from lv where level = {k} union all select flow.src, m.ctx, m.val * p from flow join ({known}) m on m.src = flow.dst where level = {k} and m.val * p > {EPS * ALPHA!r}::double{crossed}) group by 1, 2)")
        out[query] = _base(DAG, *ctes, "b as (select * from m0 union all select * from m1 union all select * from m2 union all select * from m3)", recursive=True) + result
    out["triples_file"] = f"select s, p, o from ({everything})"
    out["triples_file_no_literals"] = f"select s, p, o from ({everything}) where o not like '\"%'"
    out["vocab_file"] = out["vocab_with_edges"]
    out["rank_file"] = out["tsv_rank_map"]

    def named(name: str, vector: str) -> str:
        return f"select '{name}' as name, (src + 1)::int as word1, (ctx + 1)::int as word2, {_q('val')} from {vector}"

    def matrix(alpha: str, eps: str, weigher: str = "UniformWeigher", entities: str = "no", edges: str = "yes", graph: str = "g") -> str:
        return f"/glove_input_file-{graph}-no_literals-forwardWeigher_{weigher}-alpha_{alpha}-eps_{eps}-onlyEntities_{entities}-edges_{edges}.bin"

    out["file_to_matrix"] = _base(TYPED, u, _walk("f", "we", 0.7, 1e-5), _vector("b", "f", "we", 0.7, True, 1e-5), recursive=True) + named(matrix("0.69999999999999996", "1.0000000000000001e-05"), "b")
    ctes, parts = [u], []
    for i, (alpha, shown) in enumerate(((0.1, "0.10000000000000001"), (0.2, "0.20000000000000001"), (0.3, "0.29999999999999999"), (0.4, "0.40000000000000002"), (0.5, "0.5"))):
        for k, (eps, tiny) in enumerate(((1e-5, "1.0000000000000001e-05"), (1e-4, "0.0001"))):
            ctes += [_walk(f"f{i}{k}", "we", alpha, eps), _vector(f"b{i}{k}", f"f{i}{k}", "we", alpha, True, eps)]
            parts.append(named(matrix(shown, tiny), f"b{i}{k}"))
    out["experiment_files"] = _base(CYCLIC, *ctes, recursive=True) + " union all ".join(parts)
    ways = (u, "back as (select dst as src, p, src as dst from edges)", _weighted("1.0", "wb", "back"), _walk("f", "we", 0.3, 1e-5), _walk("h", "wb", 0.3, 1e-5), _vector("v1", "f", "we", 0.3, True, 1e-5), _vector("v2", "h", "wb", 0.3, True, 1e-5), "s as (select src, ctx, sum(val) as val from (select * from v1 union all select * from v2) group by 1, 2)", "b as (select src, ctx, val / sum(val) over (partition by src) as val from s where src <> ctx)")
    out["two_way_files"] = _base(TYPED, *ways, recursive=True) + named("/glove_input_file-g-forward_UniformWeigher-reverse_UniformWeigher-alpha_0.29999999999999999-eps_1.0000000000000001e-05-onlyEntities_no-normalize_yes.bin", "b")
    alphas = "(values ('0.69999999999999996'), ('0.10000000000000001')) a(a), (values ('no'), ('yes')) e(e), (values ('yes'), ('no')) d(d)"
    grid = " union all ".join(f"select 'out{matrix('@', '1.0000000000000001e-05', n, '#', '%', 'a_b_nt')}' as name" for n in GRID_WEIGHERS)
    out["run_names"] = f"select replace(replace(replace(name, '@', a), '#', e), '%', d) as name from ({grid}), {alphas} union all select 'out/glove_vocab_' || x || '_edges_a_b_nt.txt' from (values ('with'), ('no')) v(x)"
    return out
