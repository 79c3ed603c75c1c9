"""Whole documents of any size: diagrams, change logs, checklists and schema files as numbered blocks.

A document is a table (n, text): its blocks in order, from 0, that stand in the
file with a newline between. Parts are laid out by a key of part, group, place and
name and numbered over ranges, so that no task and no row holds a document; only
totals come to the driver. Blocks that tie in the key are ordered by their text's hash.
``sources.block_files`` writes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.text import last_segment, sanitize_id
from ..numbering import numbered
from . import diff
from .graph import participants
from .rendering import contents_line, node_shape, symbol_section

# Styles of edges and nodes.
CIRCULAR = RECURSIVE = "stroke:%s,stroke-width:2px"
STYLES = {"circular": CIRCULAR % "red", "recursive": RECURSIVE % "orange", "entry": "fill:#90EE90,stroke:#228B22", "leaf": "fill:#ADD8E6,stroke:#4682B4"}

# How nodes of each shape are written.
SHAPES = {"stadium": "    %s([%s])", "rounded": "    %s(%s)", "rect": "    %s[%s]"}

# Titles and marks of a checklist's groups, passed first.
GROUPS = {"error": ("Critical", "✅", "❌"), "warning": ("Warnings", "✅", "⚠️"), "info": ("Recommendations", "✅", "ℹ️")}

# Titles of a change log's sections, in order, and marks of changes.
SECTIONS = ["Breaking Changes", "Deprecations", "New Features", "Other Changes"]
MARKS = {"added": "**+**", "removed": "**-**", "modified": "**~**", "deprecated": "**⚠**", "renamed": "**→**"}

SCHEMA_HEAD = "# Generated types\nschema {\n  query: Query\n}\n\ntype Query {\n  _health: String\n}\n"


def label(c: Column) -> Column:
    """A label without brackets, double quotes as single ones; 'unknown' for none."""
    plain = F.regexp_replace(F.replace(c, F.lit('"'), F.lit("'")), r"[\[\](){}]", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(plain)


def part(rows: DataFrame, number: int | Column, text: Column, group: Column | None = None, at: Column | None = None, name: Column | None = None, mark: Column | None = None) -> DataFrame:
    """Rows as blocks of a document's part; a null in the key comes first."""
    key = [(group, "string", ""), (at, "long", 0), (name, "string", "")]
    named = [F.coalesce(F.lit(default) if c is None else c.cast(kind), F.lit(default)).cast(kind) for c, kind, default in key]
    return rows.select((number if isinstance(number, Column) else F.lit(number)).alias("part"), *[c.alias(k) for c, k in zip(named, ("group", "at", "name"), strict=True)], (F.lit(None) if mark is None else mark).cast("string").alias("mark"), text.alias("text"))


def line(spark: SparkSession, number: int, text: str) -> DataFrame:
    """One block of its own."""
    return part(spark.range(1), number, F.lit(text))


def assembled(parts: list[DataFrame]) -> DataFrame:
    """(n, part, group, name, mark, text) of all parts, in the order of their keys.

    Equal blocks are told apart by a running number, so that many of them are no single range.
    """
    rows = reduce(DataFrame.unionByName, parts)
    order = ["part", "group", "at", "name", F.xxhash64("text", "mark"), F.monotonically_increasing_id()]
    return numbered(rows, order).select("n", "part", "group", "name", "mark", "text")


def followed(blocks: DataFrame, more: DataFrame) -> DataFrame:
    """Both documents as one: (n, text)."""
    before = blocks.count()
    return blocks.select("n", "text").unionByName(more.select((F.col("n") + before).alias("n"), "text"))


def _edge(said: Column) -> Column:
    a, b = sanitize_id(F.col("src")), sanitize_id(F.col("dst"))
    return F.when(said.isNull(), F.concat(F.lit("    "), a, F.lit(" --> "), b)).otherwise(F.concat(F.lit("    "), a, F.lit(" -->|"), label(said), F.lit("| "), b))


def _node(text: Column, shape: Column) -> Column:
    return F.coalesce(*[F.when(shape == s, F.format_string(form, sanitize_id(F.col("id")), label(text))) for s, form in SHAPES.items()])


def _flow_chart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges (parts 1 and 2, with marks) under a head, then a style for each mark: of nodes by id, of edges by number.

    Styles come by kind of mark (circular, entry, leaf, recursive), then in the order of the lines.
    """
    lines = assembled([line(nodes.sparkSession, 0, "graph TD"), nodes, edges])
    first = 1 + lines.filter("part = 1").count()
    marked = lines.select("n", "part", "name", F.explode(F.split("mark", ",")).alias("mark"))
    style = F.coalesce(*[F.when(F.col("mark") == m, s) for m, s in STYLES.items()])
    target = F.when(F.col("part") == 1, F.concat(F.lit("style "), sanitize_id(F.col("name")))).otherwise(F.concat(F.lit("linkStyle "), (F.col("n") - first).cast("string")))
    return followed(lines, assembled([part(marked, 0, F.concat(F.lit("    "), target, F.lit(" "), style), group=F.col("mark"), at=F.col("n"))]))


def dependency_chart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, text): a flow chart of files (id, path) and edges (src, dst, pos, imports, in_cycle); imports counts names.

    Nodes by id, edges by pos and ends, then a style for each circular edge.
    """
    said = F.when(F.col("imports") > 0, F.concat(F.col("imports").cast("string"), F.lit(" import"), F.when(F.col("imports") > 1, "s").otherwise("")))
    mark = F.when(F.col("in_cycle"), "circular")
    boxes = part(nodes, 1, _node(last_segment(F.col("path")), F.lit("rect")), name=F.col("id"))
    return _flow_chart(boxes, part(edges, 2, _edge(said), at=F.col("pos"), name=F.concat_ws("\n", "src", "dst"), mark=mark))


def _calls() -> Column:
    return F.when(F.col("calls") > 1, F.concat(F.col("calls").cast("string"), F.lit(" calls")))


def call_chart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, text): a flow chart of symbols (id, name, is_entry, is_leaf) and calls (src, dst, pos, calls, recursive).

    Shapes tell entries and leaves; a node may be both. Styles come last.
    """
    text = _node(F.coalesce("name", "id"), node_shape(F.col("is_entry"), F.col("is_leaf")))
    marks = F.nullif(F.concat_ws(",", F.when(F.col("is_entry"), "entry"), F.when(F.col("is_leaf"), "leaf")), F.lit(""))
    boxes = part(nodes, 1, text, name=F.col("id"), mark=marks)
    return _flow_chart(boxes, part(edges, 2, _edge(_calls()), at=F.col("pos"), name=F.concat_ws("\n", "src", "dst"), mark=F.when(F.col("recursive"), "recursive")))


def sequence_chart(calls: DataFrame) -> DataFrame:
    """(n, text): participants of calls (src, dst, pos, calls, recursive) in order of appearance, then an arrow for each call."""
    spark = calls.sparkSession
    if calls.isEmpty():
        return assembled([line(spark, 0, "sequenceDiagram"), line(spark, 1, "    Note over System: No calls to display")]).select("n", "text")
    own, to = sanitize_id(F.col("id")), sanitize_id(F.col("dst"))
    arrow = F.concat(F.lit("    "), sanitize_id(F.col("src")), F.when(F.col("recursive"), "-->>").otherwise("->>"), to, F.lit(": "), F.coalesce(_calls(), F.lit("call")))
    note = F.when(F.col("recursive"), F.concat(F.lit("\n    Note right of "), to, F.lit(": recursive"))).otherwise("")
    named = part(participants(calls), 1, F.concat(F.lit("    participant "), own, F.lit(" as "), label(F.col("id"))), at=F.col("first"))
    drawn = part(calls, 3, F.concat(arrow, note), at=F.col("pos"), name=F.concat_ws("\n", "src", "dst"))
    return assembled([line(spark, 0, "sequenceDiagram"), named, line(spark, 2, ""), drawn]).select("n", "text")


def checklist(checks: DataFrame) -> DataFrame:
    """(n, text): checks (name, severity, passed, value, target; the last two as they are shown) by severity under their score."""
    total = checks.agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), F.round(F.try_divide(F.count_if("passed") * 100, F.count("*"))).cast("long").alias("score"))
    score = F.format_string("# Documentation Hardening Checklist\n\n**Score: %d%%** (%d/%d checks passed)\n", F.coalesce("score", F.lit(0).cast("long")), "p", "n")
    parts = [part(total, 0, score)]
    for k, (severity, (title, good, bad)) in enumerate(GROUPS.items(), 1):
        own = checks.filter(F.col("severity") == severity)
        here = own.agg(F.count("*").alias("n")).filter("n > 0")
        verdict = F.when(F.col("passed"), "Pass").otherwise("Fail") if severity == "error" else F.format_string("%s (target: %s)", "value", "target")
        item = F.concat(F.when(F.col("passed"), f"- {good} **").otherwise(f"- {bad} **"), "name", F.lit("**: "), verdict)
        parts += [part(here, 3 * k, F.lit(f"## {title}\n")), part(own, 3 * k + 1, item, name=F.col("name")), part(here, 3 * k + 2, F.lit(""))]
    return assembled(parts).select("n", "text")


def schema_file(symbols: DataFrame) -> DataFrame:
    """(n, text): a head, then a type for each interface, type or class (path, name, kind, description), quotes escaped."""
    own = symbols.filter(F.col("kind").isin("interface", "type", "class"))
    said = F.replace(F.coalesce("description", F.lit("")), F.lit('"'), F.lit('\\"'))
    text = F.concat(F.lit('"""'), said, F.lit('"""\ntype '), "name", F.lit(" {\n  _id: ID\n}\n"))
    return assembled([line(symbols.sparkSession, 0, SCHEMA_HEAD), part(own, 1, text, group=F.col("path"), name=F.col("name"))]).select("n", "text")


def module_files(symbols: DataFrame) -> DataFrame:
    """(module, n, text): a file for each module of symbols (module, name, kind, signature, description, params), one behind the other.

    A title, contents by kind, then a section for each symbol by name. A module with a
    third of all symbols is as many ranges as its blocks fill. Without a module: ''.
    """
    own = symbols.withColumn("module", F.coalesce("module", F.lit(""))).withColumn("kind", F.coalesce("kind", F.lit("")))
    module, last = F.col("module"), F.lit("\x02")  # behind the names of a kind, as the mark before them is \x01
    kinds = own.select("module", "kind").distinct()
    listed = lambda *name: F.concat(F.col("kind"), F.lit("\x01"), *name)
    parts = [
        part(kinds.select("module").distinct(), 0, F.concat(F.lit("# "), module, F.lit("\n")), group=module),
        part(kinds, 0, F.concat(F.lit("### "), "kind"), group=module, at=F.lit(1), name=F.col("kind")),
        part(own, 0, contents_line(F.col("name"), F.col("description")), group=module, at=F.lit(1), name=listed("name")),
        part(kinds, 0, F.lit(""), group=module, at=F.lit(1), name=F.concat("kind", last)),
        part(symbol_section(own), 0, F.concat("text", F.lit("\n")), group=module, at=F.lit(2), name=F.col("name")),
    ]
    return assembled(parts).select(F.col("group").alias("module"), "n", "text")


def change_log(before: DataFrame, after: DataFrame, old: str, new: str, generated: str) -> DataFrame:
    """(n, text): the changes between exports (path, name, signature, description, deprecated) as a change log.

    Head, recommended bump and totals, modules that came or went, sections of changes
    by module, each with its sentence and, where it changed, both signatures. A
    module's heading is left out where it is its section's only one.
    """
    spark = before.sparkSession
    changes, modules = checkpointed(diff.diff_exports(before, after)), checkpointed(diff.diff_modules(before, after))
    n, bump = diff.diff_summary(changes, modules).first(), diff.semver_bump(changes, modules).first()["bump"]
    counts = [("Total changes", n["total"]), ("Breaking changes", n["breaking"]), ("Additions", n["additions"]), ("Modifications", n["modifications"]), ("Deprecations", n["deprecations"]), ("Modules affected", n["modules_affected"])]
    head = f"# Changelog\n\n> Comparing {old} to {new}\n\n## Recommended Version Bump: **{bump.upper()}**\n\n## Summary\n\n" + "\n".join(f"- {k}: {v}" for k, v in counts) + "\n"
    breaking = F.when(F.col("breaking"), " **BREAKING**").otherwise("")
    came = F.concat(F.when(F.col("change") == "added", "- + `").otherwise("- - `"), "path", F.lit("`"), breaking)
    any_module = modules.agg(F.count("*").alias("n")).filter("n > 0")
    parts = [line(spark, 0, head), part(any_module, 1, F.lit("## Module Changes\n")), part(modules, 2, came, name=F.col("path")), part(any_module, 3, F.lit(""))]

    side = lambda df, c: df.dropDuplicates(["path", "name"]).select("path", "name", F.col("signature").alias(c))
    signed = changes.filter("signature_changed").select("path", "name").join(side(before, "b"), ["path", "name"]).join(side(after, "a"), ["path", "name"])
    told = diff.describe_changes(changes).join(signed, ["path", "name"], "left")
    shown = lambda word, c: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(f"\n    - {word}: `%s`", c)).otherwise("")
    signatures = F.when(F.col("signature_changed"), F.concat(F.lit("\n  - Signature changed:"), shown("Before", F.col("b")), shown("After", F.col("a")))).otherwise("")
    mark = F.coalesce(*[F.when(F.col("change") == c, m) for c, m in MARKS.items()], F.lit("**•**"))
    text = F.concat(F.lit("- "), mark, F.lit(" `"), "name", F.lit("`"), breaking, F.lit("\n  - "), "description", signatures, F.lit("\n"))
    c = F.col("change")
    places = F.array_compact(F.array(F.when(F.col("breaking"), 0), F.when(c == "deprecated", 1), F.when((c == "added") & ~F.col("breaking"), 2), F.when(~F.col("breaking") & ~c.isin("deprecated", "added"), 3)))
    dealt = checkpointed(told.select("path", "name", F.explode(places).alias("section"), text.alias("text")))
    groups = dealt.groupBy("section", "path").agg(F.count("*").alias("n"))
    several = groups.groupBy("section").agg(F.count("*").alias("n"))  # four rows at most
    headed = several.select("section").unionByName(modules.filter("breaking").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(0).alias("section"))).distinct()
    place = F.col("section") + 10
    titles = part(headed, place, F.element_at(F.array(*[F.lit(f"## {t}\n") for t in SECTIONS]), F.col("section") + 1), at=F.lit(-1))
    paths = part(groups.select("section", "path").join(F.broadcast(several.filter("n > 1")), "section"), place, F.concat(F.lit("### "), "path", F.lit("\n")), group=F.col("path"))
    body = part(dealt, place, F.col("text"), group=F.col("path"), at=F.lit(1), name=F.col("name"))
    return assembled([*parts, titles, paths, body, line(spark, 99, f"---\n\n*Generated at {generated}*")]).select("n", "text")
