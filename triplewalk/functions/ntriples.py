"""N-Triples lines as columns, without a UDF.

Terms keep their lexical form: brackets, quotes, language tags and datatypes. ``compat`` reproduces two habits of an older
reader: a resource object runs to the last ``>`` of the line, and a literal loses two characters for each final dot or space.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
OWL_THING = "<http://www.w3.org/2002/07/owl#Thing>"
_IRI, _BLANK = r"<[^>]*>", r"_:[^ ]*"


class Terms(NamedTuple):
    s: Column
    p: Column
    o: Column
    ok: Column


def is_content(line: Column) -> Column:
    """Neither white space alone nor a comment, whose first character is ``#``."""
    return ~line.rlike(r"^\s*$") & ~line.startswith("#")


def after(text: Column, term: Column) -> Column:
    """What follows the first occurrence of ``term``."""
    return F.substr(text, F.instr(text, term) + F.length(term))


def subject(line: Column) -> Column:
    bracket, blank = F.instr(line, F.lit("<")), F.instr(line, F.lit("_:"))
    return F.when((blank > 0) & ((bracket == 0) | (blank < bracket)), F.regexp_extract(line, _BLANK, 0)).otherwise(F.regexp_extract(line, _IRI, 0))


def literal(text: Column, compat: bool = False) -> Column:
    """A literal without the final dot of its line."""
    return F.regexp_replace(text, r"(?s)(?:.[ .])+$", "") if compat else F.regexp_replace(text, r"\s*\.\s*$", "")


def object_(text: Column, compat: bool = False) -> Column:
    """The object at the start of ``text`` after spaces; empty if it's none."""
    o = F.regexp_replace(text, "^ +", "")
    first = F.substring(o, 1, 1)
    return F.when(first == "_", F.regexp_extract(o, _BLANK, 0)).when(first == "<", F.regexp_extract(o, r"(?s)^<.*>" if compat else "^" + _IRI, 0)).when(first == '"', literal(o, compat)).otherwise("")


def parse(line: Column, compat: bool = False) -> Terms:
    s = subject(line)
    rest = after(line, s)
    p = F.regexp_extract(rest, _IRI, 0)
    o = object_(after(rest, p), compat)
    return Terms(s, p, o, (s != "") & (p != "") & (o != ""))


def with_terms(lines: DataFrame, compat: bool = False) -> DataFrame:
    """``lines`` with s, p, o and ok of their ``value``. Each term is made once, from columns: as one nested expression they'd outgrow
    generated code, and filters on them would be pushed below the generator and parse again."""
    rest = lines.withColumn("_s", subject(F.col("value"))).withColumn("_after_s", after(F.col("value"), F.col("_s")))
    rest = rest.withColumn("_p", F.regexp_extract("_after_s", _IRI, 0)).withColumn("_after_p", after(F.col("_after_s"), F.col("_p")))
    rest = rest.withColumn("_o", object_(F.col("_after_p"), compat))
    terms = F.struct(F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o"), ((F.col("_s") != "") & (F.col("_p") != "") & (F.col("_o") != "")).alias("ok"))
    return rest.select(*lines.columns, F.inline(F.array(terms)))


def is_literal(o: Column) -> Column:
    return o.startswith('"')
