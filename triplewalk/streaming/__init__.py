"""Triples from a stream of N-Triples files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ntriples as nt


def stream_ntriples(spark: SparkSession, folder: str, compat: bool = False) -> DataFrame:
    """(s, p, o) of the lines of new files; the same expressions as in batch. Malformed lines are left out."""
    source = spark.readStream.format("text").option("lineSep", "\n").load(folder)
    return nt.with_terms(source.filter(nt.is_content(F.col("value"))).select("value"), compat).filter("ok").select("s", "p", "o")
