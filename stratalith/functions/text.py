"""Column functions over strings: hashing, tokens, paths, comments, diffs, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search ignores.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "as", "is", "was", "are", "were", "been", "be", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "this", "that", "these", "those", "what",
    "which", "who", "whom", "how", "when", "where", "why", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "same", "so", "than", "too", "very", "just", "find", "get",
]

# Synonyms for query expansion.
CODE_SYNONYMS = {
    "function": ["method", "func", "fn", "procedure"],
    "class": ["type", "struct", "object"],
    "variable": ["var", "let", "const", "field", "property"],
    "error": ["exception", "throw", "catch", "bug", "issue"],
    "test": ["spec", "unit", "integration", "e2e"],
    "async": ["await", "promise", "callback", "concurrent"],
    "import": ["require", "include", "use", "dependency"],
    "export": ["expose", "public", "module"],
    "create": ["new", "init", "construct", "make", "build"],
    "delete": ["remove", "destroy", "drop", "clear"],
    "update": ["modify", "change", "set", "patch"],
    "get": ["fetch", "retrieve", "read", "load"],
    "send": ["post", "push", "emit", "dispatch"],
    "receive": ["handle", "listen", "subscribe", "on"],
}

# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go",
}


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and all others, as \\w has it; here they would know other letters.

    A boundary before plain letters is asked for behind them, so that the search
    looks at the letters first and back only where they stand.
    """
    word = r"[a-zA-Z0-9_]"
    head = pattern.removesuffix(r"\b")
    behind = re.sub(r"\\b([a-zA-Z]+)(?![a-zA-Z*+?{|])", lambda m: f"{m[1]}(?<!{word}{m[1]})", head)
    return behind.replace(r"\b", f"(?<!{word})") + (f"(?!{word})" if head != pattern else "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r\u00a0\u2028\u2029\ufeff"))


# --- hashing -------------------------------------------------------------------------


def hash_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def signature_hash(c: Column) -> Column:
    """First 8 hex digits of the MD5."""
    return F.substring(F.md5(c), 1, 8)


# --- tokens --------------------------------------------------------------------------


def tokenize(c: Column, min_length: int = 2) -> Column:
    """Lower-case words of ASCII word characters, longer than ``min_length`` and no stop words."""
    words = F.split(_replaced(F.lower(c), (r"[^\w\s]", " ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > min_length) & ~w.isin(STOP_WORDS))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def estimate_tokens(c: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up; 0 for the empty text."""
    return F.ceil(utf16_length(c) / 4)


def truncate_to_tokens(c: Column, most: int) -> Column:
    """At most ``most`` estimated tokens, cut at the last white space there is."""
    if most <= 0:
        return F.lit("")
    head = F.substring(c, 1, 4 * most + 1)
    whole = F.regexp_extract(head, r"(?s)^(.*)[ \t\n\r]", 1)
    return F.when(estimate_tokens(c) <= most, c).otherwise(F.when(head.rlike(r"(?s)^.+[ \t\n\r]"), whole).otherwise(F.substring(c, 1, 4 * most)))


def summarize(c: Column, lines: int = 10) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n")


def highlight(terms: list[str], c: Column, most: int = 3) -> Column:
    """Up to three lines that hold a term, the terms set in double asterisks one after the other."""
    line = lambda x: reduce(lambda a, t: a | F.contains(F.lower(x), F.lit(t)), terms, F.lit(False))
    marked = lambda x: strip(reduce(lambda a, t: F.regexp_replace(a, f"(?i)({t})", r"**$1**"), terms, x))
    return F.transform(F.slice(F.filter(F.split(c, "\n"), line), 1, most), marked)


def expand_query(query: str) -> list[str]:
    """The query and its variants with a synonym in place of a keyword, each once."""

    words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", query.lower(), flags=re.ASCII)) if len(w) > 2 and w not in STOP_WORDS]
    variants = [re.sub(w, s, query, flags=re.IGNORECASE) for w in words for s in CODE_SYNONYMS.get(w, [])]
    return list(dict.fromkeys([query, *variants]))


def query_variants(c: Column) -> Column:
    """expand_query of a column: the text, then its variants in the order of its keywords, each once."""
    synonyms = F.create_map(*[x for k, v in CODE_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    known = F.filter(tokenize(c), lambda w: w.isin(list(CODE_SYNONYMS)))
    found = F.transform(known, lambda w: F.transform(synonyms[w], lambda s: F.regexp_replace(c, F.concat(F.lit("(?i)"), w), s)))
    return F.array_distinct(F.concat(F.array(c), F.flatten(found)))


# --- comments ------------------------------------------------------------------------


def is_doc_comment(c: Column) -> Column:
    return c.rlike(r"^(/\*\*|///|\"\"\"|'''|##)")


def clean_comment(c: Column) -> Column:
    """The comment without its markers."""
    return strip(_replaced(c, (r"^/\*\*?|\*/$", ""), (r"(?m)^///?", ""), (r"(?m)^\s*\*\s?", ""), (r"^\"\"\"|\"\"\"$", ""), (r"^'''|'''$", "")))


def strip_comments(c: Column, language: Column | None = None) -> Column:
    """The code without comments: hash and quoted ones for Python, slashes for all others."""
    slashes = _replaced(c, (r"(?m)//.*$", ""), (r"/\*[\s\S]*?\*/", ""))
    if language is None:
        return slashes
    hashes = _replaced(c, (r"(?m)#.*$", ""), (r"'''[\s\S]*?'''", ""), (r'"""[\s\S]*?"""', ""))
    return F.when(language == "python", hashes).otherwise(slashes)


# --- paths and names -----------------------------------------------------------------


def language_of(path: Column, default: str | None = "typescript") -> Column:
    """Language by extension."""
    known = lookup(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), LANGUAGES)
    return F.coalesce(known, F.lit(default)) if default else known


def normalize_module_path(c: Column) -> Column:
    """No file scheme, forward slashes, no slash before a drive."""
    return _replaced(c, (r"^file://", ""), (r"\\", "/"), (r"^/([A-Za-z]:)", "$1"))


def decode_uri_path(c: Column) -> Column:
    """The path of a file URI, percent signs decoded and plus signs kept."""
    plain = normalize_module_path(c)
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def _folded(parts: Column) -> Column:
    """Path segments with . and .. worked in."""
    step = lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def resolve_import(source: Column, importer: Column) -> Column:
    """A relative import against the importer's folder; others as they are."""
    base = F.slice(F.split(importer, "/"), F.lit(1), F.greatest(F.size(F.split(importer, "/")) - 1, F.lit(0)))
    joined = F.array_join(_folded(F.concat(base, F.split(source, "/"))), "/")
    rooted = F.when(importer.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(source.startswith("."), rooted).otherwise(source)


def module_path(path: Column, root: str) -> Column:
    """Relative to the root ('index' for the root); else from the last src folder, else the last three segments."""
    root = root.rstrip("/")
    inside = F.substring(path, len(root) + 2, 1 << 30)
    source = F.regexp_extract(path, r"/(src/.*)$", 1)
    last = F.split(F.regexp_replace(path, r"^/+", ""), "/")
    return F.when(path == root, F.lit("index")).when(path.startswith(root + "/"), inside).when(source != "", source).otherwise(F.array_join(F.slice(last, F.greatest(F.size(last) - 2, F.lit(1)), F.lit(3)), "/"))


def qualified_name(path: Column, name: Column) -> Column:
    """Base name without extension, a dot, the name."""
    return F.concat(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("."), name)


def symbol_id(uri: Column, name: Column, parent: Column) -> Column:
    path = F.replace(F.regexp_replace(uri, r"^\w+:/*", ""), F.lit("/"), F.lit("."))
    return F.concat(path, F.lit(":"), F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("#"))).otherwise(""), name)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def slugify(c: Column) -> Column:
    return _replaced(F.lower(c), (r"[^a-z0-9]+", "-"), (r"^-|-$", ""))


def sanitize_id(c: Column) -> Column:
    """An identifier for diagrams: other characters as underscores, none at the ends, 'node' if nothing is left."""
    plain = _replaced(c, (r"[^a-zA-Z0-9]", "_"), (r"^_+|_+$", ""))
    return F.when(plain == "", F.lit("node")).otherwise(plain)


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def escape_markdown(c: Column) -> Column:
    return _replaced(c, (r"\|", r"\\|"), ("<", "&lt;"), (">", "&gt;"))


def matches_query(c: Column, query: str) -> Column:
    """Any text for the empty query; else a substring, or the query's characters in order."""

    if not query:
        return F.lit(True)
    spread = "(?is)" + ".*?".join(re.escape(ch) for ch in query)
    return F.contains(F.lower(c), F.lit(query.lower())) | c.rlike(spread)


def is_watch_excluded(path: Column, output: str = ".output") -> Column:
    """Paths that no watch regenerates: dependencies, build results and the tool's own output folder."""

    return path.rlike(rf"node_modules|{re.escape(output)}|dist/|build/")


# --- diffs, specifications, signatures -----------------------------------------------


def summarize_diff(c: Column) -> Column:
    """'n files (+a/-r)', with header lines counted as the lines they look like."""
    n = lambda p: F.regexp_count(c, F.lit(p)).cast("string")
    return F.concat(n("diff --git"), F.lit(" files (+"), n(r"(?m)^\+"), F.lit("/-"), n(r"(?m)^-"), F.lit(")"))


def split_diff(c: Column) -> Column:
    """array<struct<path, diff>> of a diff's files."""
    parts = F.transform(F.split(c, r"(?=diff --git)"), lambda p: F.struct(F.regexp_extract(p, r"diff --git a/(.+?) b/", 1).alias("path"), p.alias("diff")))
    return F.filter(parts, lambda p: p["path"] != "")


def parse_spec_ids(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), strip), lambda x: x != "")


def auto_spec_id(description: Column, line: Column) -> Column:
    """The first three words in capitals joined by dashes, else AUTO-line."""
    words = F.split(_replaced(description, (r"[^a-zA-Z0-9\s]", "")), r"\s+")
    name = F.upper(F.array_join(F.slice(words, 1, 3), "-"))
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.concat(F.lit("AUTO-"), line.cast("string")))


def normalize_params(c: Column) -> Column:
    """'name: type' of each comma-separated parameter, trimmed."""
    one = lambda p: F.when(F.size(F.split(p, ":")) > 1, F.concat(strip(F.split(p, ":")[0]), F.lit(": "), strip(F.split(p, ":")[1]))).otherwise(strip(p))
    return F.array_join(F.filter(F.transform(F.split(c, ","), one), lambda p: p != ""), ", ")


def normalize_interface_body(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, r"[;\n]"), strip), lambda x: (x != "") & ~x.startswith("//"))
    return F.array_join(F.array_sort(lines), "; ")


# --- formatting ----------------------------------------------------------------------


def format_bytes(c: Column) -> Column:
    """1024-step units, one decimal unless it is 0."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")])
    step = F.least(F.floor(F.log(c.cast("double")) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    number = F.regexp_replace(F.round(c / F.pow(F.lit(1024.0), step), 1).cast("string"), r"\.0$", "")
    return F.when(c <= 0, F.lit("0 Bytes")).otherwise(F.concat(number, F.lit(" "), F.element_at(units, step + 1)))


def parse_ram(c: Column) -> Column:
    """Bytes of a text such as '2GB', 0 if it isn't one."""
    pattern = r"(?i)^(\d+(?:\.\d+)?)\s*(GB|MB|KB|TB)$"
    unit = lookup(F.upper(F.regexp_extract(c, pattern, 2)), {"KB": str(1 << 10), "MB": str(1 << 20), "GB": str(1 << 30), "TB": str(1 << 40)}).cast("double")
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("double") * unit, F.lit(0.0))


def format_relative_time(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, text(s / 60, "m ago")).when(s < 86400, text(s / 3600, "h ago")).when(s < 604800, text(s / 86400, "d ago")).otherwise(F.date_format(ts, "M/d/yyyy"))


def format_speed(c: Column) -> Column:
    """Bytes a second in B, KB or MB."""
    one = lambda x: F.format_string("%.1f", x)
    kb, mb = c / F.lit(1024.0), c / F.lit(1048576.0)
    return F.when(c < 1024, F.concat(F.round(c).cast("long").cast("string"), F.lit(" B/s"))).when(c < 1048576, F.concat(one(kb), F.lit(" KB/s"))).otherwise(F.concat(one(mb), F.lit(" MB/s")))
