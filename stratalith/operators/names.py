"""Names resolved over files: references, call edges and type targets from source text.

A name in a file is the innermost definition whose scope holds it; else an
imported one, followed through files that export it again; a member is found in
the class of ``this``, or in the class or module that its owner names. All steps
are joins: postings of a name meet its scopes by the overlap join, imports meet
files by path, and chains of exports are followed while any is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from . import graph, scanner
from .overlap import overlap_join

TYPES = ("class", "interface", "enum", "module")
CALLABLE = ("function", "method", "constructor")


def _innermost(points: DataFrame, scopes: DataFrame, on: list[str], of: list[str]) -> DataFrame:
    """(of..., scope) for points whose ``at`` lies in a scope (on..., at, end, ...): the scope that begins last."""
    one = points.select(*dict.fromkeys([*of, *on, "at"]), F.col("at").alias("start_line"), F.col("at").alias("end_line"))
    two = scopes.withColumn("start_line", F.col("at")).withColumn("end_line", F.col("end") - 1)
    met = overlap_join(one, two, on)
    return met.groupBy(*[F.col(f"left.{c}").alias(c) for c in of]).agg(F.max_by("right", F.struct("right.at", "right.id")).alias("scope"))


def exported_from(bindings: DataFrame, tops: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target): what each file exports, its own top definitions (path, name, id) and names exported again, through any chain; the first found counts.

    bindings (path, pos, source, imported, local, again) are those of ``import_bindings``.
    """
    again = bindings.filter("again")
    edges = graph.resolve_imports(again.select(F.col("path").alias("importer"), "pos", "source"), files.select("path"))
    links = checkpointed(again.join(edges, (again["path"] == edges["importer"]) & (again["pos"] == edges["pos"])).select("path", "imported", "local", F.col("target").alias("from")))
    told = level = checkpointed(tops.groupBy("path", "name").agg(F.min("id").alias("target")))
    while True:
        there = level.select(F.col("path").alias("from"), "name", "target")
        named = links.join(there, (links["from"] == there["from"]) & (links["imported"] == there["name"])).select(links["path"], F.col("local").alias("name"), "target")
        whole = links.filter("imported = '*' AND local IS NULL").join(there, "from").filter("name <> 'default'").select("path", "name", "target")
        new = named.unionByName(whole).groupBy("path", "name").agg(F.min("target").alias("target"))
        level = checkpointed(new.join(told.select("path", "name"), ["path", "name"], "left_anti"))
        if level.isEmpty():
            return told
        told = told.unionByName(level)


def resolve_names(files: DataFrame) -> DataFrame:
    """path, name, at, line, call, typed, target: each word that names a definition of these files (path, content), with the definition's id.

    An id is "path#pos" of ``symbol_tree``. Methods and fields are seen behind a dot
    alone. Words that name nothing known are left out; null files have none.
    """
    symbols = checkpointed(scanner.symbol_tree(files).withColumn("id", F.concat_ws("#", "path", "pos")))
    uses = checkpointed(scanner.name_uses(files))
    bound = checkpointed(scanner.import_bindings(files))
    above = symbols.select("path", F.col("pos").alias("parent"), F.col("kind").alias("above"), F.col("at").alias("from"), F.col("end").alias("to"))
    placed = checkpointed(symbols.join(above, ["path", "parent"], "left"))
    member = F.col("above").isin("class", "interface")
    lexical = placed.filter(~F.coalesce(member, F.lit(False)))
    scopes = lexical.select("path", "name", "id", F.coalesce("from", F.lit(0).cast("long")).alias("at"), F.coalesce("to", F.lit(1 << 40)).alias("end"))
    key = ["path", "name", "at"]
    plain = uses.filter("NOT member")
    near = _innermost(plain, scopes, ["path", "name"], key).select(*key, F.col("scope.id").alias("target"))

    tops = lexical.filter("parent < 0").select("path", "name", "id")
    tops = tops.unionByName(lexical.filter("parent < 0").filter(F.col("signature").rlike(r"^export\s+default\b")).select("path", F.lit("default").alias("name"), "id"))
    exports = checkpointed(exported_from(bound, tops, files))
    edges = graph.resolve_imports(bound.select(F.col("path").alias("importer"), "pos", "source"), files.select("path"))
    local = bound.filter("NOT again AND local IS NOT NULL").join(edges.withColumnRenamed("importer", "path"), ["path", "pos"]).select("path", F.col("local").alias("name"), "imported", F.col("target").alias("file"))
    first = checkpointed(local.groupBy("path", "name").agg(F.min_by(F.struct("imported", "file"), F.struct("file", "imported")).alias("x")).select("path", "name", "x.*"))
    there = exports.select(F.col("path").alias("file"), F.col("name").alias("imported"), "target")
    imported = first.join(there, ["file", "imported"]).select("path", "name", "target")
    far = plain.join(near, key, "left_anti").join(imported, ["path", "name"]).select(*key, "target")
    direct = checkpointed(near.unionByName(far))

    behind = uses.filter("member AND owner IS NOT NULL")
    classes = symbols.filter(F.col("kind").isin(*TYPES)).select("path", F.col("name").alias("class"), "id", "at", "end")
    this = behind.filter(F.col("owner").isin("this", "self"))
    own = _innermost(this, classes, ["path"], key).select(*key, F.col("scope.id").alias("owner_id"))
    known = direct.select("path", F.col("name").alias("owner"), "target").distinct()
    told = known.groupBy("path", "owner").agg(F.min("target").alias("owner_id"))  # an owner of several meanings in a file stands for the first
    named = behind.filter(~F.col("owner").isin("this", "self")).join(told, ["path", "owner"]).select(*key, "owner_id")
    members = symbols.filter("parent >= 0").select(F.concat_ws("#", "path", "parent").alias("owner_id"), "name", "id").groupBy("owner_id", "name").agg(F.min("id").alias("target"))
    by_class = own.unionByName(named).join(members, ["owner_id", "name"]).select(*key, "target")
    spaces = first.filter("imported = '*'").select("path", F.col("name").alias("owner"), "file")
    by_space = behind.join(spaces, ["path", "owner"]).join(exports.select(F.col("path").alias("file"), "name", "target"), ["file", "name"]).select(*key, "target")
    found = direct.unionByName(by_class).unionByName(by_space)
    return uses.select(*key, "line", "call", "typed").join(found, key)


def references(resolved: DataFrame) -> DataFrame:
    """target, path, line, at of every reference to a definition."""
    return resolved.select("target", "path", "line", "at").distinct()


def hovers(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, name, at, contents: what is known of the definition behind a word, its signature and then its documentation."""
    told = symbols.select(F.col("id").alias("target"), F.concat_ws("\n\n", "signature", "documentation").alias("contents"))
    return resolved.join(told, "target").select("path", "name", "at", "contents")


def type_targets(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, name, at, target of names that stand for a type and are defined as one, symbols (id, kind)."""
    kinds = symbols.filter(F.col("kind").isin("type", *TYPES)).select(F.col("id").alias("target"))
    return resolved.filter("typed").join(kinds, "target", "left_semi").select("path", "name", "at", "target")


def text_call_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, calls: calls attributed to the innermost callable symbol (path, id, kind, at, end) around them; src is null at the top of a file."""
    calls = resolved.filter("call")
    callers = symbols.filter(F.col("kind").isin(*CALLABLE)).select("path", "id", "at", "end")
    around = _innermost(calls, callers, ["path"], ["path", "at"]).select("path", "at", F.col("scope.id").alias("src"))
    return calls.join(around, ["path", "at"], "left").groupBy("src", F.col("target").alias("dst")).agg(F.count("*").alias("calls"))
