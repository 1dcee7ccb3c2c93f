"""Transition weights: functions from edges(src, p, dst, ...) to the same with ``weight``, normalised over each node's out-edges.

Frequencies are grouped counts joined back, so a hub is combined where it is read rather than gathered in one window; weighing
again replaces all weights. ``WEIGHERS`` has those that need no further input, by the name that file names use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Weigher = Callable[[DataFrame], DataFrame]


def _plain(edges: DataFrame) -> DataFrame:
    return edges.drop("weight")


def frequency(edges: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """``edges`` with the number of edges that share ``keys``, parallel ones counted."""
    counts = edges.groupBy(*[F.col(k).alias("_k" + k) for k in keys]).agg(F.count("*").cast("double").alias(name))
    on = [F.col(k) == F.col("_k" + k) for k in keys]
    return edges.join(counts, on).drop(*["_k" + k for k in keys])


def normalize(edges: DataFrame, raw: Column) -> DataFrame:
    """``weight`` = raw / the sum of raw over the source's edges; NaN where that sum is 0."""
    valued = edges.withColumn("_raw", raw)
    sums = valued.groupBy(F.col("src").alias("_src")).agg(F.sum("_raw").alias("_sum"))
    weight = F.when(F.col("_sum") == 0, F.lit(float("nan"))).otherwise(F.col("_raw") / F.when(F.col("_sum") != 0, F.col("_sum")))
    return valued.join(sums, F.col("src") == F.col("_src")).withColumn("weight", weight).drop("_raw", "_src", "_sum")


def for_each_edge(edges: DataFrame, weight: Column) -> DataFrame:
    """Sets every weight to an expression over the edge, without normalising: the hook for schemes of one's own."""
    return edges.withColumn("weight", weight)


def uniform(edges: DataFrame) -> DataFrame:
    return normalize(_plain(edges), F.lit(1.0))


def _by(keys: list[str], raw: Callable[[Column], Column]) -> Weigher:
    def weigh(edges: DataFrame) -> DataFrame:
        return normalize(frequency(_plain(edges), keys), raw(F.col("_n"))).drop("_n")

    return weigh


predicate_frequency = _by(["p"], lambda n: n)
inverse_predicate_frequency = _by(["p"], lambda n: 1 / n)
object_frequency = _by(["dst"], lambda n: n)
inverse_object_frequency = _by(["dst"], lambda n: 1 / n)
inverse_object_frequency_split_down = _by(["dst"], lambda n: 1 / (n * n))
predicate_object_frequency = _by(["p", "dst"], lambda n: n)
inverse_predicate_object_frequency = _by(["p", "dst"], lambda n: 1 / n)


def push_down(node_weight: DataFrame) -> Weigher:
    """Weights of nodes, ``node_weight(id, w)`` with every node, pushed along the edges into them."""

    def weigh(edges: DataFrame) -> DataFrame:
        ranks = node_weight.select(F.col("id").alias("_id"), F.col("w").alias("_w"))
        return normalize(_plain(edges).join(ranks, F.col("dst") == F.col("_id")), F.col("_w")).drop("_id", "_w")

    return weigh


def split_down(node_weight: DataFrame) -> Weigher:
    """As ``push_down``, but a node's weight is divided among the edges into it."""

    def weigh(edges: DataFrame) -> DataFrame:
        ranks = node_weight.select(F.col("id").alias("_id"), F.col("w").alias("_w"))
        return normalize(frequency(_plain(edges), ["dst"]).join(ranks, F.col("dst") == F.col("_id")), F.col("_w") / F.col("_n")).drop("_id", "_w", "_n")

    return weigh


def push_down_map(node_weight: DataFrame, nodes: DataFrame, default: float, compat_source_side: bool = False) -> Weigher:
    """Weights of labels, ``node_weight(label, w)``, pushed along the edges into them, ``default`` for labels without one; unknown
    labels are ignored. ``compat_source_side`` takes the weight of the edge's source, which normalising undoes."""

    def weigh(edges: DataFrame) -> DataFrame:
        ranks = nodes.join(node_weight, "label").select(F.col("id").alias("_id"), F.col("w").alias("_w"))
        end = "src" if compat_source_side else "dst"
        return normalize(_plain(edges).join(ranks, F.col(end) == F.col("_id"), "left"), F.coalesce("_w", F.lit(float(default)))).drop("_id", "_w")

    return weigh


WEIGHERS: dict[str, Weigher] = {
    "UniformWeigher": uniform,
    "PredicateFrequencyWeigher": predicate_frequency,
    "InversePredicateFrequencyWeigher": inverse_predicate_frequency,
    "ObjectFrequencyWeigher": object_frequency,
    "InverseObjectFrequencyWeigher": inverse_object_frequency,
    "InverseObjectFrequencyWeigherSplitDown": inverse_object_frequency_split_down,
    "PredicateObjectFrequencyWeigher": predicate_object_frequency,
    "InversePredicateObjectFrequencyWeigher": inverse_predicate_object_frequency,
}
PARAMETRIC = {"Pushdownweigher": push_down, "PushdownweigherMap": push_down_map, "Splitdownweigher": split_down}
