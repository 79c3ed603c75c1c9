"""Traceability: references to specifications in code against those that documents define."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import percent
from ..functions.text import auto_spec_id, parse_spec_ids

# Patterns of references in code, with the kind of each.
CODE_PATTERNS = [
    ("requirement", r"(?i)@requirements?\s+([^\n*]+)"), ("spec", r"(?i)@spec\s+([^\n*]+)"), ("ticket", r"(?i)@ticket\s+([^\n*]+)"), ("doc", r"(?i)@see\s+([^\n*]+)"),
    ("requirement", r"(?i)//\s*REQ[-_]?(\d+)"), ("spec", r"(?i)//\s*SPEC[-_]?([A-Z0-9-]+)"), ("ticket", r"(?i)TODO[:\s]+([A-Z]+-\d+)"), ("ticket", r"(?i)FIXME[:\s]+([A-Z]+-\d+)"),
    ("requirement", r"(?i)//!\s*Requirements?:\s*([^\n]+)"),
]

# Patterns of definitions in documents; group 1 the id, group 2 the text.
DOC_PATTERNS = [
    r"(?i)^#+\s*(?:REQ|Requirement)[-_\s]*(\d+|[A-Z0-9-]+)()", r"(?i)^#+\s*(?:SPEC|Specification)[-_\s]*([A-Z0-9-]+)()",
    r"(?i)^-\s*\[[ x]\]\s*(?:REQ|SPEC)?[-_]?([A-Z0-9-]+)?:?\s*(.+)", r"(?i)^\d+\.\s*(?:REQ|Requirement)[-_]?(\d+)?:?\s*(.+)",
]


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def specs_in_code(files: DataFrame) -> DataFrame:
    """(path, line, id, type) of references in files (path, content)."""
    lines = _lines(files)

    def refs(kind: str, pattern: str) -> Column:
        ids = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), parse_spec_ids))
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(kind).alias("type")))

    found = F.flatten(F.array(*[refs(kind, p) for kind, p in CODE_PATTERNS]))
    return lines.select("path", "line", F.explode(found).alias("r")).select("path", "line", "r.id", "r.type")


def specs_in_docs(files: DataFrame) -> DataFrame:
    """(path, line, id, description) of definitions; one without an id gets one from its words."""
    parts = []
    for p in DOC_PATTERNS:
        said = F.nullif(F.regexp_extract("text", p, 2), F.lit(""))
        hit = _lines(files).filter(F.col("text").rlike(p))
        parts.append(hit.select("path", "line", F.coalesce(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), auto_spec_id(said, F.col("line"))).alias("id"), said.alias("description")))
    return reduce(DataFrame.unionByName, parts)


def cross_reference(code: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, state): implemented code references (or tickets), unimplemented definitions."""
    done = code.join(docs.select("id").distinct(), "id", "left_semi").select("id").unionByName(code.filter("type = 'ticket'").select("id")).distinct()
    open_ = docs.join(code.select("id").distinct(), "id", "left_anti").select("id").distinct()
    return done.withColumn("state", F.lit("implemented")).unionByName(open_.withColumn("state", F.lit("unimplemented")))


def trace_gaps(states: DataFrame, undocumented: DataFrame) -> DataFrame:
    """(id, kind, severity): open specifications and undocumented symbols (name)."""
    a = states.filter("state = 'unimplemented'").select("id", F.lit("unimplemented-spec").alias("kind"), F.lit("warning").alias("severity"))
    return a.unionByName(undocumented.select(F.col("name").alias("id"), F.lit("undocumented-symbol").alias("kind"), F.lit("info").alias("severity")))


def trace_report(states: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: implemented, defined, coverage (100 without definitions; over 100 where code names others)."""
    a = states.agg(F.count_if(F.col("state") == "implemented").alias("implemented"))
    b = docs.agg(F.count_distinct("id").alias("defined"))
    return a.crossJoin(b).withColumn("coverage", percent(F.col("implemented"), F.col("defined")))  # one row each
