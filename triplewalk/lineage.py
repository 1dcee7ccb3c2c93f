"""Cutting lineage in the folder all executors share, and dense numbering on top of it."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share. Only a session within one process (a test) may name
    none, and gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lineage-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def number(df: DataFrame, by: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with dense numbers from ``start`` in the order of ``by``, which has to be total.

    A distributed sort, then an offset for each partition; no partition ever holds all rows. The sorted rows are
    checkpointed, so that the numbers stay if an executor is lost."""
    at = cut(df.orderBy(*by)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in at.groupBy(part.alias("part")).count().collect())
    offsets, total = [], start
    for k, n in sizes:
        offsets.append((k, total))
        total += n
    if not offsets:
        return at.select(*df.columns, F.lit(None).cast("bigint").alias(name))
    known = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")  # a row for each partition
    return at.join(F.broadcast(known), part == F.col("_part")).select(*df.columns, (F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
