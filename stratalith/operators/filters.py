"""Plain predicates and projections over chunks, checks, models and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup
from ..numbering import numbered

# Kinds that count as exported, content types, levels.
EXPORTABLE = ["class", "interface", "function", "method", "enum", "variable", "constant", "type", "module"]
CONTENT_TYPES = ["code", "comments", "docs", "commits", "prs"]
CHUNK_LEVELS = ["project", "module", "file", "symbol"]


def code_symbols(chunks: DataFrame) -> DataFrame:
    return chunks.filter("type = 'code' AND level = 'symbol'")


def doc_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter("type IN ('comments', 'docs')")


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.filter(~F.col("passed"))


def checks_by_severity(checks: DataFrame, severity: str) -> DataFrame:
    return checks.filter(F.col("severity") == severity)


def is_exportable(kind: Column) -> Column:
    return kind.isin(EXPORTABLE)


def filtered_entries(entries: DataFrame, status: str | None = None, path: str = "") -> DataFrame:
    """Entries (path, status) of a status whose path holds a text, whatever its case."""
    rows = entries.filter(F.contains(F.lower("path"), F.lit(path.lower())))
    return rows.filter(F.col("status") == status) if status else rows


def filtered_models(models: DataFrame, category: str | None = None, cached: bool | None = None, query: str = "") -> DataFrame:
    rows = models.filter(F.contains(F.lower(F.concat_ws(" ", "name", "description", "id")), F.lit(query.lower())))
    rows = rows.filter(F.col("category") == category) if category else rows
    return rows if cached is None else rows.filter(F.col("is_cached") == cached)


def text_chat_models(models: DataFrame) -> DataFrame:
    return models.filter(F.array_contains("modalities", "text"))


def parse_collection(name: Column) -> Column:
    """struct<type, level> of a collection's name, null unless both are known."""
    kind, level = F.regexp_extract(name, r"^([a-z]+)_([a-z]+)$", 1), F.regexp_extract(name, r"^([a-z]+)_([a-z]+)$", 2)
    return F.when(kind.isin(CONTENT_TYPES) & level.isin(CHUNK_LEVELS), F.struct(kind.alias("type"), level.alias("level")))


def symbol_kind(number: Column, names: dict[str, str], default: str = "variable") -> Column:
    """A kind by its number in a protocol."""
    return F.coalesce(lookup(number.cast("string"), names), F.lit(default))


def normalized_symbols(symbols: DataFrame) -> DataFrame:
    """symbols with defaults: name 'unknown', an empty signature, empty lists."""
    none = F.array().cast("array<string>")
    return symbols.withColumns({"name": F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown")), "signature": F.coalesce("signature", F.lit("")), "modifiers": F.coalesce("modifiers", none)})


def with_severity(results: DataFrame, config: dict[str, str]) -> DataFrame:
    """Results with the severity that a configuration gives their rule; those that are off go."""
    told = F.coalesce(lookup(F.col("rule"), config), F.col("severity")) if config else F.col("severity")
    return results.withColumn("severity", told).filter(F.col("severity") != "off")


def valid_extractions(files: DataFrame) -> DataFrame:
    """files (uri, language_id, symbols) with an error where something is missing."""
    error = F.when(F.trim(F.coalesce("uri", F.lit(""))) == "", "uri is empty").when(F.col("symbols").isNull(), "symbols are missing").when(F.coalesce("language_id", F.lit("")) == "", "language is empty")
    return files.withColumn("error", error)


def merged_config(base: dict, override: dict | None) -> dict:
    """Section by section: given values replace, lists whole, maps of rules key by key."""
    out = dict(base)
    for k, v in (override or {}).items():
        out[k] = merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else base.get(k) if v is None else v
    return out


def model_options(models: DataFrame, auto: str = "auto") -> DataFrame:
    """(pos, id, label): the automatic choice, then text models, newest first."""
    rows = numbered(text_chat_models(models).filter(F.col("id") != auto), [-F.unix_micros(F.col("created").cast("timestamp")), "id"])
    first = models.sparkSession.createDataFrame([(0, auto, "Automatic")], "pos int, id string, label string")
    return first.unionByName(rows.select((F.col("n") + 1).cast("int").alias("pos"), "id", F.col("name").alias("label")))
