"""Text outputs as projections: diagrams, markdown, schema exports, index lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_markdown, sanitize_id, slugify, strip, truncate
from ..numbering import numbered


def joined(df: DataFrame, by: list[str], line: Column, order: list[str], sep: str = "\n", name: str = "text") -> DataFrame:
    """Lines of a group, in order, as one text."""
    rows = df.groupBy(*by) if by else df.groupBy()
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda r: r["line"]), sep).alias(name))


def dependency_diagram(edges: DataFrame) -> DataFrame:
    """One row: a flow chart of edges (src, dst, pos, in_cycle), circular ones with a style by number."""
    rows = numbered(edges, ["pos"])
    arrow = F.when(F.col("in_cycle"), " -.-> ").otherwise(" --> ")
    line = F.concat(F.lit("    "), sanitize_id(F.col("src")), arrow, sanitize_id(F.col("dst")))
    style = F.when(F.col("in_cycle"), F.concat(F.lit("\n    linkStyle "), F.col("n").cast("string"), F.lit(" stroke:red"))).otherwise("")
    return joined(rows, [], F.concat(line, style), ["n"]).select(F.concat(F.lit("graph TD\n"), "text").alias("text"))


def node_shape(entry: Column, leaf: Column) -> Column:
    return F.when(entry, "stadium").when(leaf, "rounded").otherwise("rect")


def sequence_diagram(edges: DataFrame) -> DataFrame:
    """One row: arrows between the ends of edges (src, dst, pos, label) in order."""
    line = F.concat(F.lit("    "), sanitize_id(F.col("src")), F.lit("->>"), sanitize_id(F.col("dst")), F.lit(": "), "label")
    return joined(edges, [], line, ["pos"]).select(F.concat(F.lit("sequenceDiagram\n"), "text").alias("text"))


def parameters_table(params: Column) -> Column:
    """A markdown table of array<struct<name, type, optional, description>>."""
    row = lambda p: F.concat(F.lit("| "), p["name"], F.lit(" | "), escape_markdown(F.coalesce(p["type"], F.lit(""))), F.lit(" | "), F.when(p["optional"], "No").otherwise("Yes"), F.lit(" | "), F.coalesce(p["description"], F.lit("")), F.lit(" |"))
    return F.concat(F.lit("| Name | Type | Required | Description |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform(params, row), "\n"))


def contents_line(name: Column, description: Column) -> Column:
    """A link to a symbol's section with its short description."""
    return F.concat(F.lit("- ["), escape_markdown(name), F.lit("](#"), slugify(name), F.lit(") - "), truncate(F.coalesce(description, F.lit("")), 60))


def table_of_contents(symbols: DataFrame) -> DataFrame:
    """module, text: symbols (module, kind, name, description) by kind, with short descriptions."""
    kinds = joined(symbols, ["module", "kind"], contents_line(F.col("name"), F.col("description")), ["name"], name="body")
    return joined(kinds, ["module"], F.concat(F.lit("### "), "kind", F.lit("\n"), "body"), ["kind"], "\n\n")


def symbol_section(symbols: DataFrame) -> DataFrame:
    """module, name, text of symbols (module, name, kind, signature, description, params)."""
    text = F.concat(F.lit("## "), "name", F.lit("\n\n`"), "kind", F.lit("`\n\n```\n"), F.coalesce("signature", F.lit("")), F.lit("\n```\n\n"), F.coalesce("description", F.lit("*No description*")), F.when(F.size("params") > 0, F.concat(F.lit("\n\n"), parameters_table(F.col("params")))).otherwise(""))
    return symbols.select("module", "name", text.alias("text"))


def module_markdown(symbols: DataFrame) -> DataFrame:
    """module, text: contents, then all sections."""
    body = joined(symbol_section(symbols), ["module"], F.col("text"), ["name"], "\n\n", "body")
    return table_of_contents(symbols).join(body, "module").select("module", F.concat(F.lit("# "), "module", F.lit("\n\n"), "text", F.lit("\n\n"), "body").alias("text"))


def changelog_markdown(sections: DataFrame) -> DataFrame:
    """One row: sections (priority, section, path, name, change) as a changelog."""
    parts = joined(sections, ["priority", "section"], F.concat(F.lit("- "), "path", F.lit(": "), "name", F.lit(" "), "change"), ["path", "name"], name="body")
    return joined(parts, [], F.concat(F.lit("## "), "section", F.lit("\n\n"), "body"), ["priority"], "\n\n")


def checklist_markdown(checks: DataFrame) -> DataFrame:
    """One row: checks (id, severity, passed, value, target) as a list."""
    line = F.concat(F.when(F.col("passed"), "- [x] ").otherwise("- [ ] "), "id", F.lit(" ("), "severity", F.lit("): "), F.col("value").cast("string"), F.lit(" / "), F.col("target").cast("string"))
    return joined(checks, [], line, ["id"])


def graphql_types(symbols: DataFrame) -> DataFrame:
    """One row: a type for each interface, type or class (name, kind, description)."""
    line = F.concat(F.lit('"""'), F.replace(F.coalesce("description", F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"""\ntype '), "name", F.lit(" {\n  id: ID\n}"))
    return joined(symbols.filter(F.col("kind").isin("interface", "type", "class")), [], line, ["name"], "\n\n")


def openapi_schemas(symbols: DataFrame) -> DataFrame:
    """name, schema (JSON) of interfaces and types (pos, name, kind, description); of equal names the last counts."""
    last = symbols.filter(F.col("kind").isin("interface", "type")).groupBy("name").agg(F.max_by("description", "pos").alias("description"))
    return last.select("name", F.to_json(F.struct(F.lit("object").alias("type"), "description")).alias("schema"))


def index_lines(symbols: DataFrame) -> DataFrame:
    """(id, label, line): JSON lines of documents and their symbols (uri, pos, start_line) with running ids."""
    docs = symbols.select("uri").distinct().select("uri", F.lit(-1).alias("pos"), F.lit("document").alias("label"), F.lit(None).cast("int").alias("start"))
    rows = docs.unionByName(symbols.select("uri", "pos", F.lit("range").alias("label"), F.col("start_line").alias("start")))
    told = numbered(rows, ["uri", "pos"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    return told.select("id", "label", F.to_json(F.struct("id", F.lit("vertex").alias("type"), "label", "uri", "start")).alias("line"))


def front_matter(stats: DataFrame) -> DataFrame:
    """One text for each snapshot (snapshot_id, modules, exports, documented): a YAML head, coverage 100 without exports."""
    from ..functions.scoring import percent, round1

    coverage = round1(percent(F.col("documented"), F.col("exports")))
    return stats.select("snapshot_id", F.concat(F.lit("---\nid: "), "snapshot_id", F.lit("\nmodules: "), F.col("modules").cast("string"), F.lit("\nexports: "), F.col("exports").cast("string"), F.lit("\ncoverage: "), coverage.cast("string"), F.lit("\n---")).alias("text"))


def parse_front_matter(texts: DataFrame) -> DataFrame:
    """(id, key, value) of the lines of a YAML head (id, text)."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    lines = texts.select("id", F.explode(F.split(head, "\n")).alias("l")).filter(F.contains("l", F.lit(":")))
    return lines.select("id", strip(F.substring_index("l", ":", 1)).alias("key"), strip(F.regexp_replace("l", r"^[^:]*:", "")).alias("value"))


def context_tokens(symbols: DataFrame) -> DataFrame:
    """symbols with the tokens of their compact JSON (name, signature, purpose)."""
    from ..functions.text import estimate_tokens

    return symbols.withColumn("tokens", estimate_tokens(F.to_json(F.struct("name", "signature", F.col("description").alias("purpose")))).cast("long"))
