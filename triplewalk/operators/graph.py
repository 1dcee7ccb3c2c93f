"""Labelled multigraphs as DataFrames.

triples(ord, s, p, o); nodes(id BIGINT, label); edges(src BIGINT, eord, p, dst BIGINT), eord rising with insertion at a source;
preds(id BIGINT, label). ``ord`` is of any orderable type and total.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ntriples import OWL_THING, RDF_TYPE, is_literal
from ..lineage import cut, number


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def drop_literals(triples: DataFrame) -> DataFrame:
    """Without triples whose object is a literal. Done before nodes are numbered: a subject that only literals have is no node."""
    return triples.filter(~is_literal(F.col("o")))


def dedup(triples: DataFrame) -> DataFrame:
    """Each (s, p, o) once, at its first place."""
    return triples.groupBy("s", "p", "o").agg(F.min("ord").alias("ord")).select("ord", "s", "p", "o")


def node_ids(triples: DataFrame) -> DataFrame:
    """nodes(id, label): dense from 0 by first appearance, a triple's subject before its object."""
    # Two minima of plain columns, which are hashed; one of (ord, side) would be sorted, all ends of them.
    no = F.lit(None)
    ends = triples.select(F.explode(F.array(F.struct(F.col("s").alias("label"), F.col("ord").alias("at_s"), no.alias("at_o")), F.struct(F.col("o").alias("label"), no.alias("at_s"), F.col("ord").alias("at_o")))).alias("x"))
    first = ends.groupBy("x.label").agg(F.min("x.at_s").alias("at_s"), F.min("x.at_o").alias("at_o"))
    side = F.when(F.col("at_s") <= F.coalesce("at_o", "at_s"), 0).otherwise(1)
    return number(first.select("label", F.least("at_s", "at_o").alias("at"), side.alias("side")), [F.col("at"), F.col("side")], "id").select("id", "label")


def encode(triples: DataFrame) -> Graph:
    """Nodes and edges, both cut: everything that follows reads them several times."""
    nodes = node_ids(triples)
    subjects, objects = (nodes.select(F.col("id").alias(i), F.col("label").alias(t)) for i, t in (("src", "s"), ("dst", "o")))
    # Triples are told apart where they lie after the last join, so that they move twice, not three times.
    edges = triples.join(subjects, "s").join(objects, "o").groupBy("src", "p", "o", "dst").agg(F.min("ord").alias("eord"))
    return Graph(nodes, cut(edges.select("src", "eord", "p", "dst")))


def predicate_ids(edges: DataFrame, n_nodes: int) -> DataFrame:
    """preds(id, label): from the number of nodes on, by first edge, over nodes by id and each node's edges by insertion."""
    first = edges.groupBy(F.col("p").alias("label")).agg(F.min(F.struct("src", "eord")).alias("at"))
    return number(first, [F.col("at"), F.col("label")], "id", n_nodes).select("id", "label")


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge the other way; ids, labels and other columns stay. Weights have to be set anew."""
    names = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*[names.get(c, F.col(c)) for c in edges.columns])


def simple(edges: DataFrame) -> DataFrame:
    """(src, dst) without self loops and parallel edges."""
    return edges.filter("src <> dst").select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node in the simple graph."""
    s = simple(edges)
    into, out = s.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), s.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    zero = F.lit(0).cast("bigint")
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("i", zero).alias("in_degree"), F.coalesce("o", zero).alias("out_degree"))


def entities(graph: Graph) -> DataFrame:
    """(id) of the nodes typed as owl:Thing."""
    thing = graph.nodes.filter(F.col("label") == OWL_THING).select(F.col("id").alias("dst"))
    return graph.edges.filter(F.col("p") == RDF_TYPE).join(F.broadcast(thing), "dst").select(F.col("src").alias("id")).distinct()


def vocabulary(nodes: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """(glove_id INT, label): ids from 1, nodes and then, if given, predicates; a label that is both has two."""
    both = nodes.select("id", "label") if preds is None else nodes.select("id", "label").unionByName(preds.select("id", "label"))
    return both.select((F.col("id") + 1).cast("int").alias("glove_id"), "label")
