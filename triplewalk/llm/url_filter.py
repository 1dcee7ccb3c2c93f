"""URL filters by host-suffix and path-prefix expressions.

Each distinct URL is expanded into every host suffix of two labels or more times its paths: with query, without, and each
folder above. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; full digests confirm. Of several
rules that match, the one with the longest host counts, then the longest path, then ``allow`` before ``block``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AUTHORITY = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PREFIX_HEX = 8


def parts(url):
    """(host, path, query) columns: no user, port, final dots or fragment; the host in lower case; '/' for no path; '' for no
    query. The host is '' if the URL isn't absolute."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    path = F.regexp_extract(url, _AUTHORITY + "([^?#]*)", 2)
    return host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"^[^?#]*([?][^#]*)", 1)


def expressions(urls: DataFrame) -> DataFrame:
    """(url, expression) for every URL of ``urls(url)``; none for a null or relative one."""
    host, path, query = parts(F.col("url"))
    split = urls.select("url", host.alias("host"), path.alias("path"), query.alias("query")).filter("host <> ''")
    address = F.col("host").rlike(r"^[0-9.]+$|^\[")
    labels, folders = F.split("host", "[.]"), F.split("path", "/")
    suffixes = F.when(address | (F.size(labels) < 2), F.array("host")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    above = F.when(F.size(folders) > 1, F.transform(F.sequence(F.lit(1), F.size(folders) - 1), lambda k: F.concat(F.array_join(F.slice(folders, 1, k), "/"), F.lit("/")))).otherwise(F.array(F.lit("/")))
    paths = F.array_distinct(F.concat(F.array(F.concat("path", "query"), F.col("path")), above))
    return split.select("url", F.explode(suffixes).alias("suffix"), paths.alias("paths")).select("url", "suffix", F.explode("paths").alias("p")).select("url", F.concat("suffix", "p").alias("expression"))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, action, rule) of every page row: what the strongest matching rule says, or ``allow`` and a null rule.

    ``rules(pattern, action)``: the pattern is host/path as in an expression, the action ``allow`` or ``block``; others, nulls
    and repeated rules change nothing. Null, empty and relative URLs match no rule. Only page_id and url are read."""
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"))
    found = expressions(base.select("url").distinct()).withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    known = rules.select(F.col("pattern").alias("rule"), F.col("action").alias("action")).filter("rule is not null and action in ('allow', 'block')").distinct()
    known = known.withColumn("full", F.sha2("rule", 256)).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    rank = F.struct((-F.instr("rule", "/")).alias("host"), (-F.length("rule")).alias("path"), "action", "rule")
    best = found.join(known, "short").filter("digest = full").groupBy("url").agg(F.min(rank).alias("best")).select(F.col("url").alias("matched"), "best")
    return base.join(best, F.col("url") == F.col("matched"), "left").select("page_id", "url", F.coalesce("best.action", F.lit("allow")).alias("action"), F.col("best.rule").alias("rule"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``filter_urls`` without the blocked rows."""
    return filter_urls(pages, rules).filter("action = 'allow'")
