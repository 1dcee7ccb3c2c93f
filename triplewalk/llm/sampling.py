"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_label(keys: DataFrame, label: str, key: str, most: int, seed: int) -> list[tuple]:
    """At most ``most`` (label, key) of each label, those with the least seeded hash of the key; the same rows at every
    partitioning. A threshold on the hash, from the label's count, leaves few rows before any are ranked."""
    clean = keys.select(F.col(f"`{label}`").alias("label"), F.col(f"`{key}`").alias("key")).filter("label is not null and key is not null").distinct()
    unit = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 40)) / float(1 << 40)
    out = []
    for label_value, n in clean.groupBy("label").count().collect():
        share = min(1.0, (1.5 * most + 50) / n)
        part = clean.filter((F.col("label") == F.lit(label_value)) & (unit < share))
        out += [(label_value, r.key) for r in part.orderBy(unit, "key").limit(most).collect()]
    return out
