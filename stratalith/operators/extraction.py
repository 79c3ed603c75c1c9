"""Symbols and exports from source text, chunks for the index, context files."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, dealt
from ..functions.text import clean_comment, estimate_tokens, hash_id, last_segment, strip
from .batches import handing

# Patterns of symbols; group 1 export, 2 name, 3 generics, 4 parameters, 5 return type.
SYMBOL_PATTERNS = [
    ("function", r"(?:/\*\*[\s\S]*?\*/\s*)?(export\s+)?(?:async\s+)?function\s+(\w+)\s*(<[^>]*>)?\s*\(([^)]*)\)\s*(?::\s*([^{;]+))?"),
    ("class", r"(?:/\*\*[\s\S]*?\*/\s*)?(export\s+)?(?:abstract\s+)?class\s+(\w+)()()()"),
    ("interface", r"(?:/\*\*[\s\S]*?\*/\s*)?(export\s+)?interface\s+(\w+)(<[^>]*>)?()()"),
    ("type", r"(?:/\*\*[\s\S]*?\*/\s*)?(export\s+)?type\s+(\w+)(<[^>]*>)?\s*=()()"),
]

# Patterns of exports on a line, in order of precedence, group 1 the name or a list of names.
EXPORT_PATTERNS = [
    (r"^\s*export\s+(?:async\s+)?function\s+(\w+)", False), (r"^\s*export\s+(?:abstract\s+)?class\s+(\w+)", False), (r"^\s*export\s+interface\s+(\w+)", False),
    (r"^\s*export\s+type\s+(\w+)", False), (r"^\s*export\s+(?:const|let|var)\s+(\w+)", False), (r"^\s*export\s+enum\s+(\w+)", False),
    (r"^\s*export\s+default\s+(?:async\s+)?function\s+(\w+)", True), (r"^\s*export\s+default\s+(?:abstract\s+)?class\s+(\w+)", True), (r"^\s*export\s+default\s+(\w+)\s*;?\s*$", True),
    (r"^\s*export\s*\{([^}]+)\}", False), (r"^\s*export\s*=\s*(\w+)", True),
    (r"^\s*pub\s+(?:async\s+)?fn\s+(\w+)", False), (r"^\s*pub\s+(?:struct|enum|trait|type|const|static|mod)\s+(\w+)", False),
    (r"^\s*(?:func|type|var|const)\s+([A-Z]\w*)", False),
]


def _symbols(path: str, content: str | None) -> Iterator[tuple]:
    content = content or ""
    feeds = [m.start() for m in re.finditer("\n", content)]
    for kind, pattern in SYMBOL_PATTERNS:
        for m in re.finditer(pattern, content, re.ASCII):
            said = f"({m[4] or ''}): {(m[5] or '').strip() or 'void'}" if kind == "function" else f"{m[2]}{m[3] or ''}"
            yield path, kind, m[2], bisect_left(feeds, m.start()) + 1, said, bool(m[1]), "/**" in content[max(0, m.start() - 200) : m.start()]


def extract_symbols(files: DataFrame, private: bool = False) -> DataFrame:
    """path, kind, name, line, signature, exported, documented of files (path, content); matches need places, so in Arrow batches."""
    rows = dealt(files.select("path", "content"), "path").mapInPandas(handing(_symbols, ["path", "content"], ["path", "kind", "name", "line", "signature", "exported", "documented"]), "path string, kind string, name string, line int, signature string, exported boolean, documented boolean")
    return rows if private else rows.filter(~F.col("name").startswith("_"))


def extract_exports(files: DataFrame) -> DataFrame:
    """path, pos, name, is_default, is_type_only of exports; of equal names the first counts."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    names = lambda p: F.filter(F.transform(F.split(F.regexp_extract("text", p, 1), ","), lambda n: strip(F.regexp_replace(n, r"^.*\sas\s", ""))), lambda n: n != "")
    found = F.flatten(F.array(*[F.transform(names(p), lambda n: F.struct(n.alias("name"), F.lit(r).alias("rank"), F.lit(d).alias("is_default"))) for r, (p, d) in _ranked()]))
    hits = lines.select("path", "line", "text", F.posexplode(found).alias("at", "x"))
    whole = F.filter(F.transform(F.split(F.regexp_extract("content", r"__all__\s*=\s*\[([^\]]+)\]", 1), ","), lambda n: strip(F.regexp_replace(n, "['\"]", ""))), lambda n: n != "")
    listed = files.select("path", F.posexplode(whole).alias("at", "name")).select("path", F.lit(1 << 30).alias("line"), F.lit("").alias("text"), "at", F.struct("name", F.lit(99).alias("rank"), F.lit(False).alias("is_default")).alias("x"))
    first = F.row_number().over(Window.partitionBy("path", "x.name").orderBy("line", "at"))
    rows = hits.unionByName(listed).withColumn("n", first).filter("n = 1")
    pos = F.row_number().over(Window.partitionBy("path").orderBy("line", "at")) - 1
    return rows.select("path", pos.alias("pos"), F.col("x.name").alias("name"), F.col("x.is_default").alias("is_default"), F.col("text").rlike(r"export\s+type\s").alias("is_type_only"))


def _ranked() -> list[tuple[int, tuple[str, bool]]]:
    return list(enumerate(EXPORT_PATTERNS))


def merge_exports(*sources: DataFrame) -> DataFrame:
    """Exports (path, name, ...) of several sources, the earlier source first for a name."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s)
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("source_rank", "pos"))
    return both.withColumn("n", n).filter("n = 1").drop("n", "source_rank")


def is_exported(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """symbols (path, name) with whether their module exports the name."""
    out = exports.select("path", "name", F.lit(True).alias("exported")).distinct()
    return symbols.join(out, ["path", "name"], "left").withColumn("exported", F.coalesce("exported", F.lit(False)))


def default_exports(exports: DataFrame) -> DataFrame:
    """(path, name): the first default export (path, pos, name, is_default) of each module that has one."""
    return exports.filter("is_default").groupBy("path").agg(F.min_by("name", "pos").alias("name"))


def schema_failures(files: DataFrame) -> DataFrame:
    """One row: files, and those without content, which no schema can be built of."""
    return files.agg(F.count("*").alias("files"), F.count_if(F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0).alias("failed"))


def text_coverage(files: DataFrame) -> DataFrame:
    """path, symbols, documented: symbols by pattern, and doc blocks up to that many."""
    c = F.col("content")
    n = lambda p: F.regexp_count(c, F.lit(p))
    found = n(r"(?:export\s+)?(?:async\s+)?function\s+\w+") + n(r"(?:export\s+)?class\s+\w+") + n(r"(?:export\s+)?interface\s+\w+") + n(r"(?:export\s+)?type\s+\w+\s*=")
    return files.select("path", found.alias("symbols"), F.least(found, n(r"/\*\*[\s\S]*?\*/")).alias("documented"))


def coverage_report(coverage: DataFrame, importance: DataFrame, detailed: bool = False) -> DataFrame:
    """Per file coverage with importance and advice, most needed first; without detail only files of importance 5 on."""
    rows = coverage.join(importance.select("path", "score"), "path", "left").withColumn("importance", F.coalesce("score", F.lit(0.0)))
    share = F.when(F.col("symbols") > 0, F.col("documented") * 100.0 / F.col("symbols"))
    advice = F.when(share.isNull(), "nothing to document").when(share < 50, "document the public symbols").when(share < 80, "fill the gaps").otherwise("good")
    rows = rows if detailed else rows.filter("importance >= 5")
    return rows.select("path", "symbols", "documented", F.round(share, 1).alias("percent"), "importance", advice.alias("advice")).orderBy(F.desc(F.col("importance") * (100 - F.coalesce(share, F.lit(0.0)))), "path")


# --- types -----------------------------------------------------------------------------

# Names of primitive types.
PRIMITIVES = ["string", "number", "boolean", "null", "undefined", "void", "never", "any", "unknown"]


def type_kind(raw: Column) -> Column:
    """array, union, intersection, primitive or reference; the array suffix comes first."""
    t = strip(raw)
    return F.when(t.endswith("[]"), "array").when(F.contains(t, F.lit(" | ")), "union").when(F.contains(t, F.lit(" & ")), "intersection").when(F.lower(t).isin(PRIMITIVES), "primitive").otherwise("reference")


def type_members(raw: Column) -> Column:
    """The parts of a type one level down: the element of an array, members of unions and intersections."""
    t = strip(raw)
    return (
        F.when(t.endswith("[]"), F.array(F.substring(t, F.lit(1), F.length(t) - 2)))
        .when(F.contains(t, F.lit(" | ")), F.transform(F.split(t, r" \| "), lambda x: strip(x)))
        .when(F.contains(t, F.lit(" & ")), F.transform(F.split(t, " & "), lambda x: strip(x)))
        .otherwise(F.array().cast("array<string>"))
    )


def parse_types(types: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, path, raw, kind) of all parts of types (id, raw), level by level; raises on parts below ``depth`` levels."""
    level = types.select("id", F.array().cast("array<int>").alias("path"), strip(F.col("raw")).alias("raw"))
    out = None
    for d in count(1):
        told = level.withColumn("kind", type_kind(F.col("raw")))
        out = told if out is None else out.unionByName(told)
        level = checkpointed(level.select("id", "path", F.posexplode(type_members(F.col("raw"))).alias("k", "part")).select("id", F.concat("path", F.array("k")).alias("path"), F.col("part").alias("raw")))
        if level.isEmpty():
            return out
        if depth is not None and d >= depth:
            raise ValueError(f"parts are left below {depth} levels")


# --- chunks ----------------------------------------------------------------------------


def symbol_chunks(symbols: DataFrame, least: int = 50) -> DataFrame:
    """Chunks of symbols (path, name, kind, text, language) of at least ``least`` tokens, with what the text says of them."""
    t, low = F.col("text"), F.lower("text")
    head = F.regexp_extract(t, r"(?s)^(.+?)\{", 1)
    line = F.split(t, "\n")[0]
    signature = F.when(head != "", strip(head)).otherwise(F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line))
    seen = lambda w: F.contains(low, F.lit(w))
    visibility = F.when(seen("private"), "private").when(seen("protected"), "protected").when(seen("internal"), "internal").otherwise("public")
    rows = symbols.filter(estimate_tokens(t) >= least)
    return rows.select(hash_id(F.col("path"), F.lit("symbol"), F.col("name")).alias("id"), "path", F.col("name").alias("symbol"), "kind", F.col("text").alias("content"), signature.alias("signature"), visibility.alias("visibility"), F.contains(t, F.lit("export")).alias("exported"))


def comment_chunks(comments: DataFrame, least: int = 50) -> DataFrame:
    """Chunks of doc comments (path, line, text, symbol), markers taken off."""
    rows = comments.withColumn("content", clean_comment(F.col("text"))).filter(estimate_tokens(F.col("content")) >= least)
    return rows.select(hash_id(F.col("path"), F.lit("comment"), F.col("line").cast("string")).alias("id"), "path", "symbol", "content")


def request_chunks(requests: DataFrame) -> DataFrame:
    """One chunk of every change request (num, title, body, comments)."""
    said = F.array_join(F.transform("comments", lambda c: F.concat(F.lit("- "), c)), "\n")
    key = F.concat(F.lit("pr-"), F.col("num").cast("string"))
    return requests.select(hash_id(key, F.lit("pr")).alias("id"), F.concat(F.lit("pr/"), F.col("num").cast("string")).alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n\n## Discussion\n"), said).alias("content"))


def file_context(content: Column, most: int = 50) -> Column:
    """The first lines that import, export, declare a module or comment."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\s*(import|export|module|//|/\*|\*|#)"))
    return F.array_join(F.slice(lines, 1, most), "\n")


def prepare(type_: Column, symbol: Column, kind: Column, language: Column, content: Column) -> Column:
    """The text that is embedded: what the chunk is, then its content, at most 2000 characters."""
    code = type_ == "code"
    label = F.when(type_ == "docs", "[documentation]").when(type_ == "comments", "[code comment]").when(type_ == "commits", "[git commit]").when(type_ == "prs", "[pull request]")
    named = F.when(code & symbol.isNotNull() & kind.isNotNull(), F.concat(F.lit("["), kind, F.lit("] "), symbol))
    return F.substring(F.concat_ws("\n", named, F.when(code & language.isNotNull(), F.concat(F.lit("Language: "), language)), label, content), 1, 2000)


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """The default embedder: a normalised bag of hashed words. A model of one's own can take its place as a Pandas UDF."""
    zero = F.array_repeat(F.lit(0.0), size)
    add = lambda v, t: F.transform(v, lambda x, i: x + F.when(F.pmod(F.xxhash64(t), F.lit(size)) == i, 1.0).otherwise(0.0))
    v = F.aggregate(tokens, zero, add)
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


# --- contexts --------------------------------------------------------------------------


def template_summary(kind: Column, name: Column, description: Column) -> Column:
    said = F.coalesce(F.nullif(description, F.lit("")), F.lit("provides functionality as defined by its signature"))
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1 << 20), F.lit(" `"), name, F.lit("` "), said, F.lit("."))


def module_purpose(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """module, text: the kinds and first three exported symbols of each module (module, pos, name, kind); no more than those are gathered."""
    out = exports.select(F.col("path").alias("module"), "name").distinct()
    place = F.row_number().over(Window.partitionBy("module").orderBy("pos", "name"))
    main = symbols.join(out, ["module", "name"], "left_semi").withColumn("n", place).filter("n <= 3").select("module", F.lit("main").alias("what"), "pos", F.col("name").alias("t"))
    kinds = symbols.groupBy("module", "kind").agg(F.min("pos").alias("pos")).select("module", F.lit("kind").alias("what"), "pos", F.col("kind").alias("t"))
    listed = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("pos", "t")))), lambda x: x["t"]), ", ")
    rows = kinds.unionByName(main).groupBy("module").agg(listed("kind").alias("kinds"), listed("main").alias("main"))
    return rows.select("module", F.concat(F.lit("Module providing "), "kinds", F.lit(" definitions. Main exports: "), F.when(F.col("main") == "", "none").otherwise(F.col("main")), F.lit(".")).alias("text"))


def context_buckets(symbols: DataFrame) -> DataFrame:
    """module, functions, classes, types: names of symbols (module, name, kind) by what they are."""
    named = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.col("name"))))
    return symbols.groupBy("module").agg(named("function", "method").alias("functions"), named("class").alias("classes"), named("interface", "type", "enum", "variable", "constant").alias("types"))


def class_members(symbols: DataFrame) -> DataFrame:
    """module, name, methods, properties of classes: symbols (module, qualified, name, kind, refs) below them or that refer to them."""
    owner = F.when(F.contains("qualified", F.lit(".")), F.array(F.element_at(F.split("qualified", r"\."), 1))).otherwise(F.array().cast("array<string>"))
    linked = symbols.select("module", "name", "kind", F.explode(F.array_distinct(F.concat(owner, F.transform("refs", lambda r: last_segment(r))))).alias("owner"))
    classes = symbols.filter("kind = 'class'").select("module", F.col("name").alias("owner"))
    of = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.col("name"))))
    return classes.join(linked, ["module", "owner"], "left").groupBy("module", F.col("owner").alias("name")).agg(of("method").alias("methods"), of("property", "field").alias("properties"))


def usage_patterns(symbols: DataFrame, most: int = 5) -> DataFrame:
    """module, usage, practices: the first example notes and replacements of symbols (module, pos, name, example, replacement); no more than those are gathered."""
    note = F.concat("name", F.lit(": "), "example")
    instead = F.concat(F.lit("Use "), last_segment(F.col("replacement")), F.lit(" instead of "), "name")
    said = lambda what, text: F.struct(F.lit(what).alias("what"), text.alias("t"))
    rows = symbols.select("module", "pos", F.explode(F.array(said("usage", note), said("practices", instead), said("module", F.lit("")))).alias("x")).select("module", "pos", "x.*").filter("t IS NOT NULL")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("module", "what").orderBy("pos", "t"))).filter(F.col("n") <= most)
    listed = lambda w: F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.struct("n", "t")))), lambda x: x["t"]).alias(w)
    return first.groupBy("module").agg(listed("usage"), listed("practices"))


def fill_descriptions(symbols: DataFrame) -> DataFrame:
    """symbols with blank or placeholder descriptions replaced by a template sentence."""
    blank = strip(F.coalesce("description", F.lit(""))).isin("", "*No description*")
    return symbols.withColumn("description", F.when(blank, template_summary(F.col("kind"), F.col("name"), F.lit(None).cast("string"))).otherwise(F.col("description")))


def migration_note(change: Column, name: Column, added: Column) -> Column:
    """A note for a removed export, or for required parameters (array of 'name: type') that were added."""
    gone = F.format_string("The `%s` export has been removed.", name)
    more = F.concat(F.lit("Old: `"), name, F.lit("(existingArgs)`; new: `"), name, F.lit("(existingArgs, { "), F.array_join(added, ", "), F.lit(" })`"))
    return F.when(change == "removed", gone).when(F.size(added) > 0, more)


def dependency_tree(edges: DataFrame, roots: DataFrame, depth: int = 2, children: int = 10) -> DataFrame:
    """(root, parent, id, level): up to ``children`` new nodes of each node, smallest first, level by level."""
    level = roots.select("root", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.col("root").alias("id"), F.lit(0).alias("level"))
    out = seen = level
    for d in range(1, depth + 1):
        step = level.select("root", F.col("id").alias("src")).join(edges.distinct(), "src").select("root", F.col("src").alias("parent"), F.col("dst").alias("id"))
        new = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min("parent").alias("parent"))
        n = F.row_number().over(Window.partitionBy("root", "parent").orderBy("id"))
        level = new.withColumn("n", n).filter(F.col("n") <= children).select("root", "parent", "id", F.lit(d).alias("level"))
        seen = seen.unionByName(level)
        out = out.unionByName(level)
    return out
