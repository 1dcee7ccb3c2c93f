"""Sparse vectors bcv(src, ctx, val), one for each src, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(*vectors: DataFrame) -> DataFrame:
    """Sum by entry; an entry of any is in the result."""
    both = vectors[0]
    for v in vectors[1:]:
        both = both.unionByName(v)
    return both.groupBy("src", "ctx").agg(F.sum("val").alias("val"))


fix_paint = add  # upsert-add of single entries is the same sum


def remove_focus(bcv: DataFrame) -> DataFrame:
    """Without each vector's entry for its own source."""
    return bcv.filter("ctx <> src")


def normalize(bcv: DataFrame) -> DataFrame:
    """Each vector divided by its sum; one whose sum is 0 has no entries."""
    sums = bcv.groupBy("src").agg(F.sum("val").alias("_sum")).filter("_sum <> 0")
    return bcv.join(sums, "src").select("src", "ctx", (F.col("val") / F.col("_sum")).alias("val"))


def add_above(eps: float, *vectors: DataFrame) -> DataFrame:
    """As ``add``, only the entries whose sum is above ``eps``."""
    return add(*vectors).filter((F.col("val") > eps) & ~F.isnan("val"))


def labelled(bcv: DataFrame, names: DataFrame) -> DataFrame:
    """(src, text): each vector as a JSON array of label, id and value, by label, for looking at; ``names(id, label)`` may hold
    predicates too, and a label twice."""
    pairs = bcv.join(names.select(F.col("id").alias("ctx"), "label"), "ctx")
    return pairs.groupBy("src").agg(F.to_json(F.sort_array(F.collect_list(F.struct("label", F.col("ctx").alias("id"), "val")))).alias("text"))
