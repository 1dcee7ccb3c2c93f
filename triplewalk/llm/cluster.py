"""What the corpus operators need of a cluster: a shared folder to cut lineage in, and components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the folder that ``spark.checkpoint.dir`` names and all executors share, so that a lost
    executor costs a read of it, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def own(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, by exact and unambiguous reference, so that extra columns can't clash with internal ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a BIGINT, b BIGINT)``: (node, root) with the least node as root, by alternating
    large-star and small-star steps, each a groupBy and join on nodes; about log(size) rounds, cut every round.

    No edges: no rows. Self loops and repeated edges change nothing."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.filter("u <> v").distinct())


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's rows of an Arrow batch to ``rows`` at most: whole documents, 10,000 of them by default, would weigh on
    every Python worker, and on the buffers of its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
