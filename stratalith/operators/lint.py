"""Lint rules: each is a filter over symbols or their exploded parameters, united into one result.

Symbols: path, name, kind, description, return_type, modifiers, examples, signature,
params array<struct<name, description>>, refs array<string>.
Results: path, name, rule, severity, message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_bounds, last_segment, strip

# Words that mark a description as a placeholder, first match counts.
PLACEHOLDERS = [
    ("todo", r"(?i)\bTODO\b"), ("fixme", r"(?i)\bFIXME\b"), ("xxx", r"\bXXX\b"), ("hack", r"(?i)\bHACK\b"),
    ("placeholder", r"(?i)\bplaceholder\b"), ("lorem-ipsum", r"(?i)\blorem\s+ipsum\b"), ("documentation-needed", r"(?i)\bdocumentation\s+needed\b"),
    ("fill-in", r"(?i)\bfill\s+in\b"), ("add-description", r"(?i)\badd\s+description\b"), ("insert-here", r"(?i)\binsert\s+.*\s+here\b"),
    ("tbd", r"(?i)\bTBD\b"), ("coming-soon", r"(?i)\bcoming\s+soon\b"),
]

# Patterns that mark a signature as a stub, first match counts.
STUBS = [
    ("throws-error", r"(?i)throw\s+new\s+Error\s*\(\s*['\"`]not\s+implemented['\"`]\s*\)"), ("throws-text", r"(?i)throw\s+['\"`]not\s+implemented['\"`]"),
    ("unimplemented", r"unimplemented!\s*\(\s*\)"), ("todo-macro", r"todo!\s*\(\s*\)"), ("panics", r"panic!\s*\(\s*['\"`]not\s+implemented['\"`]\s*\)"),
    ("pass-todo", r"(?i)pass\s*#\s*TODO"), ("raises", r"(?i)raise\s+NotImplementedError"), ("empty-body", r"\{\s*\}\s*$"), ("empty-arrow", r"=>\s*\{\s*\}\s*$"),
    ("returns-null", r"return\s+null\s*;?\s*$"), ("returns-undefined", r"return\s+undefined\s*;?\s*$"), ("returns-object", r"return\s+\{\s*\}\s*;?\s*$"), ("returns-list", r"return\s+\[\s*\]\s*;?\s*$"),
]

# Parameter names that say nothing.
GENERIC_NAMES = ["x", "y", "z", "a", "b", "c", "d", "arg", "param", "data", "input", "output", "value", "obj", "object", "item", "element", "temp", "tmp", "foo", "bar", "baz"]

DEFAULT_SEVERITY = {
    "missing-description": "error", "missing-param-description": "warning", "missing-return-description": "warning", "missing-example": "info",
    "broken-reference": "error", "undocumented-export": "error", "placeholder": "warning", "stub": "warning", "generic-parameter": "info",
}


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def first_match(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that matches, else null."""
    return reduce(lambda rest, p: F.when(c.rlike(ascii_bounds(p[1])), F.lit(p[0])).otherwise(rest), reversed(patterns), F.lit(None).cast("string"))


def _result(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select("path", "name", F.lit(rule).alias("rule"), F.lit(DEFAULT_SEVERITY[rule]).alias("severity"), message.alias("message"))


def missing_description(symbols: DataFrame) -> DataFrame:
    return _result(symbols.filter(is_blank(F.col("description"))), "missing-description", F.format_string("Symbol \"%s\" is missing a description", "name"))


def missing_param_description(symbols: DataFrame) -> DataFrame:
    params = symbols.select("path", "name", F.explode("params").alias("p")).filter(is_blank(F.col("p.description")))
    return _result(params, "missing-param-description", F.format_string("Parameter \"%s\" in \"%s\" is missing a description", "p.name", "name"))


def missing_return_description(symbols: DataFrame) -> DataFrame:
    said = F.lower(F.coalesce("description", F.lit("")))
    wanted = F.col("kind").isin("function", "method") & F.col("return_type").isNotNull() & ~F.lower("return_type").isin("void", "undefined", "never")
    rows = symbols.filter(wanted & ~(F.contains(said, F.lit("@return")) | F.contains(said, F.lit("returns "))))
    return _result(rows, "missing-return-description", F.format_string("Function \"%s\" is missing a return value description", "name"))


def missing_example(symbols: DataFrame) -> DataFrame:
    public = F.exists("modifiers", lambda m: m.isin("export", "public")) & F.col("kind").isin("function", "method", "class", "interface")
    bare = (F.coalesce(F.size("examples"), F.lit(0)) <= 0) & ~F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("@example"))
    return _result(symbols.filter(public & bare), "missing-example", F.format_string("Public symbol \"%s\" is missing a code example", "name"))


def placeholder_text(symbols: DataFrame) -> DataFrame:
    rows = symbols.withColumn("hit", first_match(F.col("description"), PLACEHOLDERS)).filter("hit IS NOT NULL")
    return _result(rows, "placeholder", F.format_string("Symbol \"%s\" has placeholder documentation: %s", "name", "hit"))


def stub_code(symbols: DataFrame) -> DataFrame:
    rows = symbols.filter(F.col("kind").isin("function", "method")).withColumn("hit", first_match(F.col("signature"), STUBS)).filter("hit IS NOT NULL")
    return _result(rows, "stub", F.format_string("Function \"%s\" appears to be a stub: %s", "name", "hit"))


def generic_parameters(symbols: DataFrame) -> DataFrame:
    params = symbols.select("path", "name", F.explode("params").alias("p"))
    rows = params.filter(F.lower("p.name").isin(GENERIC_NAMES) | F.col("p.name").rlike(r"(?i)^(arg|param|input|data)\d*$"))
    return _result(rows, "generic-parameter", F.format_string("Parameter \"%s\" in \"%s\" has a generic name", "p.name", "name"))


def broken_references(symbols: DataFrame) -> DataFrame:
    """References of which neither the whole nor the last segment is a known symbol."""
    known = symbols.select(F.col("name").alias("ref")).distinct()
    refs = symbols.select("path", "name", F.explode("refs").alias("ref"))
    rows = refs.join(known, "ref", "left_anti").withColumn("full", F.col("ref")).withColumn("ref", last_segment(F.col("ref"))).join(known, "ref", "left_anti")
    return _result(rows, "broken-reference", F.format_string("Symbol \"%s\" refers to \"%s\", which is unknown", "name", "full"))


def kept_references(symbols: DataFrame) -> DataFrame:
    """(path, name, pos, ref): references whose whole or last segment is a known symbol, in their order."""
    known = symbols.select(F.col("name").alias("key")).distinct()
    refs = symbols.select("path", "name", F.posexplode("refs").alias("pos", "ref"))
    whole = refs.join(known, F.col("ref") == F.col("key"), "left_semi")
    rest = refs.join(known, F.col("ref") == F.col("key"), "left_anti")
    return whole.unionByName(rest.join(known, last_segment(F.col("ref")) == F.col("key"), "left_semi"))


def undocumented_exports(exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exports (path, name) without a definition, or with a blank one."""
    own = symbols.select("path", "name", "description", F.lit(True).alias("here"))
    rows = exports.join(own, ["path", "name"], "left").filter(F.col("here").isNull() | is_blank(F.col("description")))
    return _result(rows, "undocumented-export", F.format_string("Export \"%s\" is undocumented", "name"))


def outdated_params(documented: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, param): names in the documentation (path, name, names) that are no parameters."""
    actual = symbols.select("path", "name", F.transform("params", lambda p: p["name"]).alias("actual"))
    return documented.join(actual, ["path", "name"]).select("path", "name", F.explode(F.array_except("names", "actual")).alias("param"))


def outdated_return(documented: Column, actual: Column) -> Column:
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.coalesce((plain(actual) != plain(documented)) & ~F.contains(plain(actual), plain(documented)), F.lit(False))


RULES = {
    "missing-description": missing_description, "missing-param-description": missing_param_description, "missing-return-description": missing_return_description,
    "missing-example": missing_example, "placeholder": placeholder_text, "stub": stub_code, "generic-parameter": generic_parameters, "broken-reference": broken_references,
}


def lint_modules(modules: DataFrame, symbols: DataFrame, severity: dict[str, str] | None = None) -> DataFrame:
    """All rules over the symbols of the modules (path) that a workspace refers to."""
    return lint(symbols.join(modules.select("path").distinct(), "path", "left_semi"), severity)


def lint(symbols: DataFrame, severity: dict[str, str] | None = None) -> DataFrame:
    """All rules over all symbols; ``severity`` overrides a rule's, and 'off' drops it from the plan."""
    told = DEFAULT_SEVERITY | (severity or {})
    parts = [f(symbols).withColumn("severity", F.lit(told[rule])) for rule, f in RULES.items() if told[rule] != "off"]
    return reduce(DataFrame.unionByName, parts)
