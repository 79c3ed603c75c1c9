"""Symbols, doc comments, names and imports of source files, by a scan that knows strings, comments and nesting.

A lexer cuts a text into comments, strings, words and marks; a stack of scopes
follows braces, or indentation in Python, and gives each symbol its parent and
range. Time is linear in the text. Names are resolved by Spark (``names``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_comment, estimate_tokens, hash_id, language_of
from .batches import handing
from .extraction import file_context, symbol_chunks
from .ranking import module_definitions

# Words that declare, and the kind of symbol.
DECLARES = {
    "class": "class", "struct": "class", "impl": "class", "interface": "interface", "trait": "interface", "enum": "enum", "type": "type", "namespace": "module", "module": "module",
    "mod": "module", "function": "function", "fn": "function", "func": "function", "const": "constant", "let": "variable", "var": "variable",
}
# Words before a declaration, and words of statements that declare nothing.
BEFORE = set("export default declare abstract async public private protected internal static readonly override final pub unsafe extern get set accessor crate".split())
CONTROL = set("if for while switch catch else do try finally return new throw await yield case import package using with in of typeof instanceof delete void super this match loop use break continue".split())
RESERVED = CONTROL | BEFORE | set(DECLARES) | set("extends implements from as def lambda pass raise except and or not is True False None null undefined true false".split())

_COMMON = r"(?P<word>[^\W\d][\w$]*|[$#@][^\W\d]?[\w$]*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<mark>=>|->|::|\?\.|.)"
BRACES = re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?)|" + _COMMON)
RUST = re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\]++|\\[\s\S])*+\"?|'(?:\\.[^']*|[^'\\\n])')|" + _COMMON)
PYTHON = re.compile(r"(?P<comment>#[^\n]*)|(?P<string>(?:[rbfuRBFU]{0,2})(?:\"\"\"(?:[^\\\"']++|\\[\s\S]|[\"'])*?(?:\"\"\"|\Z)|'''(?:[^\\\"']++|\\[\s\S]|[\"'])*?(?:'''|\Z)|\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?))|" + _COMMON)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n]){0,60}\]|[^/\\\n\[]){1,500}/\w*")  # bounded, so that many that never end cost no more
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(`|\$\{|\\?\Z)")
SCRIPTS = ("typescript", "javascript", "typescriptreact", "javascriptreact")


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    end: int


class Symbol(NamedTuple):
    pos: int
    parent: int
    kind: str
    name: str
    at: int
    end: int
    body: int  # where the body begins, or the end
    named_at: int
    doc: str | None
    exported: bool


def tokens(content: str, language: str) -> Iterator[Token]:
    """Comments, strings (also regular expressions and pieces of templates), words, numbers, lines and marks."""
    pattern = PYTHON if language == "python" else RUST if language == "rust" else BRACES
    script, at, before, nested, depth = language in SCRIPTS, 0, "", [], 0

    def template(start: int, inside: int) -> Token:
        m = _TEMPLATE.match(content, inside)
        if m[1] == "${":
            nested.append(depth)
        return Token("string", content[start : m.end()], start, m.end())

    while at < len(content):
        c = content[at]
        if c == "`" and (script or language == "go"):
            end = (content.find("`", at + 1) + 1) or len(content)
            t = template(at, at + 1) if script else Token("string", content[at:end], at, end)
        elif c == "}" and nested and nested[-1] == depth:
            nested.pop()
            t = template(at, at + 1)
        elif c == "/" and script and (before in "(,=:[!&|?{};+-*%<>~^" or before in ("return", "typeof", "case", "=>", "in", "of")) and (m := _REGEX.match(content, at)):
            t = Token("string", m[0], at, m.end())
        else:
            m = pattern.match(content, at)
            t = Token(m.lastgroup, m[0], at, m.end())
            depth += (t.text == "{") - (t.text == "}") if t.kind == "mark" else 0
        at = t.end
        if t.kind not in ("blank", "comment", "line"):
            before = t.text
        if t.kind != "blank":
            yield t


def is_doc(text: str) -> bool:
    return text.startswith(("/**", "///", '\"\"\"', "'''", "##"))


def declared(head: list[Token], scope: str, owner: str, language: str) -> tuple[str, Token] | None:
    """(kind, name) of what a statement declares, from its first words."""
    i = 0
    while i < len(head) and (head[i].text in BEFORE or head[i].text[0] in "@(" or head[i].kind == "string"):
        if head[i].text[0] == "@" and i + 1 < len(head) and head[i + 1].text == ".":
            i += 2
        if head[i].text in BEFORE and i + 1 < len(head) and head[i + 1].text in (":", "=", "?") or head[i].text == "(" and not i:
            break  # a member of that name, or an expression
        if i + 1 < len(head) and head[i + 1].text == "(" and (head[i].text[0] == "@" or head[i].text == "pub"):
            open_ = 0
            while i + 1 < len(head):
                i += 1
                open_ += (head[i].text == "(") - (head[i].text == ")")
                if not open_:
                    break
        elif i + 1 < len(head) and head[i + 1].text == "(":
            break
        i += 1
    rest = head[i:]
    if not rest or rest[0].kind != "word" or rest[0].text in CONTROL:
        return None
    words = [t for t in rest if t.kind == "word"]
    first = rest[0].text
    kind = DECLARES.get(first)
    if kind and len(rest) > 1 and (rest[1].kind == "word" or first in ("function", "impl", "func")):
        name = rest[1]
        if first == "const" and name.text in ("enum", "fn") and len(rest) > 2:
            kind, name = DECLARES[name.text], rest[2]
        elif first == "impl":
            depth, plain = 0, []
            for t in rest[1:]:
                depth += (t.text == "<") - (t.text == ">")
                plain += [t] if t.kind == "word" and not depth else []
            name = plain[-1] if plain else words[-1]
        elif first == "func" and name.text == "(":  # a method with a receiver
            close = next((k for k, t in enumerate(rest) if t.text == ")"), len(rest))
            kind, name = "method", rest[close + 1] if close + 1 < len(rest) else name
        elif first == "type" and len(rest) > 2 and rest[2].text in ("struct", "interface"):
            kind = DECLARES[rest[2].text]
        elif first == "function" and name.text == "*" and len(rest) > 2:
            name = rest[2]
        elif first in ("const", "let", "var"):
            if name.text in ("mut",) and len(rest) > 2:
                name = rest[2]
            after = [t.text for t in rest[2:]]
            value = after[after.index("=") + 1 :] if "=" in after else []
            value = value[1:] if value[:1] == ["async"] else value
            if value[:1] == ["function"] or "=>" in value and (value[0] in "(<" or value[1:2] == ["=>"]):
                kind = "function"
        if name.kind != "word" or name.text in ("extends", "implements", "in", "of"):
            return None
        return ("method" if kind == "function" and scope in ("class", "interface") else kind), name
    if scope not in ("class", "interface"):
        return None
    texts = [t.text for t in rest]
    call = texts.index("(") if "(" in texts else len(texts)
    value = min((texts.index(x) for x in ("=", "=>") if x in texts), default=len(texts))
    if call < value and call < (texts.index(":") if ":" in texts and language in SCRIPTS else len(texts)):
        generic = next((k for k in range(call - 1, -1, -1) if rest[k].kind == "word" and texts[k + 1] in ("(", "<", "?")), None)
        if generic is None:
            return None
        return ("constructor" if texts[generic] in ("constructor", owner) else "method"), rest[generic]
    if language in SCRIPTS:
        return ("field", rest[0]) if texts[1:2] and texts[1] in (":", "=", "?", "!") or len(rest) == 1 else None
    named = [t for t in rest[:value] if t.kind == "word"]
    return ("field", named[-1]) if language == "java" and len(named) > 1 else None


_OPEN_END = set("= => ( [ { , . ?. : ? & | && || + - * / < > ! extends implements".split())
_OPEN_START = set(". ?. ? : & | = => , ) ] + * / < > { extends implements throws where".split())


def brace_symbols(found: list[Token], language: str) -> tuple[list[Symbol], list[tuple[Token, str | None]]]:
    """(symbols in order of their starts, doc comments with the symbol that follows each)."""
    symbols: list[list] = []
    docs: list[list] = []
    scopes: list[tuple] = []
    head: list[Token] = []
    open_, scope, owner, inside, made, doc, said = 0, "file", "", -1, -1, None, None
    solid = [t for t in found if t.kind not in ("comment", "line")]
    following = iter(solid)
    after = next(following, None)

    def declare(end: int, body: int | None) -> int:
        nonlocal made
        told = declared(head, scope, owner, language) if made < 0 and head else None
        if told:
            out = any(t.text in ("export", "pub") for t in head[:3]) or language == "go" and told[1].text[:1].isupper() or language == "java" and any(t.text == "public" for t in head[:4])
            symbols.append([len(symbols), inside, told[0], told[1].text, head[0].at, end, end if body is None else body, told[1].at, said and said[0].text, out])
            made = len(symbols) - 1
            if said:
                said[1] = told[1].text
        return made

    def closed(end: int) -> None:
        nonlocal head, open_, made, said
        if head:
            if declare(end, None) >= 0:
                symbols[made][5] = max(symbols[made][5], end)
        head, open_, made, said = [], 0, -1, None

    for t in found:
        if t.kind == "comment":
            if is_doc(t.text):
                docs.append([t, None])
                doc = docs[-1] if not head else doc
            continue
        if t.kind == "line":
            last = head[-1].text if head else ""
            if head and not open_ and language in (*SCRIPTS, "go") and last not in _OPEN_END and not (after and after.text in _OPEN_START):
                closed(head[-1].end)
            continue
        after = next(following, None)
        if t.text == "{" and t.kind == "mark":
            last = head[-1].text if head else ""
            expression = open_ > 0 or last in ("=", ":", ",", "return", "(", "[", "=>", "?", "&", "|") or not head and scope == "value"
            symbol = declare(t.end, t.at) if not open_ or made >= 0 else made
            pushed = symbols[symbol][2] if symbol >= 0 else ""
            scopes.append((head, open_, scope, owner, inside, made, said, expression and symbol < 0 or expression))
            if symbol >= 0:
                inside, owner = symbol, symbols[symbol][3]
            scope = pushed if pushed in ("class", "interface", "enum", "module") and not open_ else "value" if expression and last != "=>" else "body"
            head, open_, made, said, doc = [], 0, -1, None, None
        elif t.text == "}" and t.kind == "mark":
            closed(t.at)
            if scopes:
                head, open_, scope, owner, inside, made, said, goes_on = scopes.pop()
                if made >= 0:
                    symbols[made][5] = t.end
                if goes_on:
                    head.append(t)
                else:
                    head, open_, made, said = [], 0, -1, None
            doc = None
        elif t.text in ";," and t.kind == "mark" and not open_ and (t.text == ";" or scope in ("value", "enum") or scope == "class" and language == "rust"):
            closed(t.end)
            doc = None
        else:
            if not head:
                said, doc = doc, None
            head.append(t)
            if t.kind == "mark":
                open_ = max(0, open_ + (t.text in "([") - (t.text in ")]"))
    closed(solid[-1].end if solid else 0)
    for symbol in [s[5] for s in scopes if s[5] >= 0]:  # braces that are never closed
        symbols[symbol][5] = solid[-1].end
    return [Symbol(*s) for s in symbols], [tuple(d) for d in docs]


def indent_symbols(found: list[Token], content: str) -> tuple[list[Symbol], list[tuple[Token, str | None]]]:
    """The same by indentation; a string that opens a body is its doc."""
    symbols: list[list] = []
    docs: list[list] = []
    scopes: list[tuple[int, int]] = []  # (indentation, symbol)
    open_, begins, end, line, doc, opened = 0, True, 0, [], None, -1

    def closed() -> None:
        nonlocal line, doc, opened
        if line:
            words = [t for t in line if t.kind == "word"]
            indent = line[0].at - content.rfind("\n", 0, line[0].at) - 1
            while scopes and indent <= scopes[-1][0]:
                symbols[scopes[-1][1]][5] = symbols[scopes[-1][1]][5] if symbols[scopes[-1][1]][5] > line[0].at else max(symbols[scopes[-1][1]][5], before)
                scopes.pop()
            parent = scopes[-1][1] if scopes else -1
            k = 1 if words and words[0].text == "async" else 0
            told = None
            if len(words) > k + 1 and line[k].text in ("def", "class"):
                told = ("class" if line[k].text == "class" else "method" if parent >= 0 and symbols[parent][2] == "class" else "function", words[k + 1])
            elif len(line) > 1 and line[0].kind == "word" and line[1].text in ("=", ":") and (parent < 0 or symbols[parent][2] == "class") and line[0].text not in RESERVED:
                told = ("constant" if line[0].text.isupper() else "variable" if parent < 0 else "field", line[0])
            if len(line) == 1 and line[0].kind == "string" and is_doc(line[0].text):
                docs.append([line[0], symbols[opened][3] if opened >= 0 else None])
                if opened >= 0:
                    symbols[opened][8] = line[0].text
            opened = -1
            if told:
                symbols.append([len(symbols), parent, told[0], told[1].text, line[0].at, end, line[-1].end, told[1].at, doc and doc[0].text, not told[1].text.startswith("_")])
                if doc:
                    doc[1] = told[1].text
                if line[k].text in ("def", "class"):
                    scopes.append((indent, len(symbols) - 1))
                    opened = len(symbols) - 1
            doc = None
        line = []

    before = 0
    for t in found:
        if t.kind == "comment":
            if is_doc(t.text):
                docs.append([t, None])
                doc = docs[-1]
        elif t.kind == "line":
            if not open_:
                closed()
                before = end
        else:
            line.append(t)
            end = t.end
            open_ = max(0, open_ + (t.text in "([{") - (t.text in ")]}")) if t.kind == "mark" else open_
    closed()
    for _, symbol in scopes:
        symbols[symbol][5] = max(symbols[symbol][5], end)
    return [Symbol(*s) for s in symbols], [tuple(d) for d in docs]


def structure(content: str, language: str) -> tuple[list[Token], list[Symbol], list[tuple[Token, str | None]]]:
    found = list(tokens(content, language))
    return (found, *(indent_symbols(found, content) if language == "python" else brace_symbols(found, language)))


def bindings(found: list[Token], language: str) -> list[tuple[str, str, str | None, bool]]:
    """(source, name there or * for all, name here, exported again) of imports."""
    solid, out, i = [t for t in found if t.kind not in ("comment", "line")], [], 0
    while i < len(solid):
        t = solid[i]
        first = t.text in ("from", "import", "export") and (i == 0 or solid[i - 1].text in (";", "}") or "\n" in _between(found, solid[i - 1], t))
        if language == "python" and first and t.text in ("from", "import"):
            line, j = [], i
            while j < len(solid) and (j == i or "\n" not in _between(found, solid[j - 1], solid[j]) or "(" in line and ")" not in line):
                line.append(solid[j].text)
                j += 1
            source = "".join(line[1 : line.index("import")]) if t.text == "from" and "import" in line else None
            for part in "\0".join(line[line.index("import") + 1 :]).replace("\0(\0", "").replace("(\0", "").split("\0,\0") if "import" in line else []:
                words = [x for x in part.split("\0") if x not in "()"]
                if words:
                    name = "".join(words[: words.index("as")] if "as" in words else words)
                    out.append((source, name, words[-1], False) if source is not None else (name, "*", words[-1], False))
            i = j
            continue
        if language in SCRIPTS and first and t.text in ("import", "export"):
            j = i + 1
            while j < len(solid) and solid[j].kind != "string" and solid[j].text in ("{", "}", ",", "*", "type", "from", "as", "default") or j < len(solid) and solid[j].kind == "word" and solid[j].text not in DECLARES and solid[j].text not in BEFORE:
                j += 1
            texts = [x.text for x in solid[i + 1 : j]]
            if j < len(solid) and solid[j].kind == "string" and texts[-1:] == ["from"]:
                source, texts = solid[j].text.strip("'\"`"), texts[:-1]
                again = t.text == "export"
                named = texts[texts.index("{") + 1 :] if "{" in texts else []
                plain = texts[: texts.index("{")] if "{" in texts else texts
                for part in "\0".join(x for x in named if x != "}").split("\0,\0") if named else []:
                    words = [x for x in part.strip("\0,").split("\0") if x not in ("type", "")]
                    if words:
                        out.append((source, words[0], words[-1], again))
                if "*" in plain:
                    out.append((source, "*", plain[plain.index("*") + 2] if "as" in plain else None, again))
                elif not again and (whole := [x for x in plain if x not in (",", "type")]):
                    out.append((source, "default", whole[0], False))
                i = j
        i += 1
    return out


def _between(found: list[Token], a: Token, b: Token) -> str:
    """Whether a line ends between two tokens that follow each other."""
    return "\n" if b.at > a.end and any(t.kind == "line" for t in _span(found, a.end, b.at)) else ""


def _span(found: list[Token], low: int, high: int) -> Iterator[Token]:
    from bisect import bisect_left

    for k in range(bisect_left(found, low, key=lambda t: t.at), len(found)):
        if found[k].at >= high:
            return
        yield found[k]


def _lines(content: str) -> Callable[[int], int]:
    from bisect import bisect_right

    begins = [0, *(m.end() for m in re.finditer("\n", content))]
    return lambda at: bisect_right(begins, at)


def _scanned(rows: Callable[[str, str], Iterator[tuple]], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(path: str, language: str, content: str | None) -> Iterator[tuple]:
        for r in rows(content or "", language):
            yield path, *r

    return handing(run, ["path", "language", "content"], ["path", *columns])


def _apply(files: DataFrame, rows: Callable[[str, str], Iterator[tuple]], shape: str) -> DataFrame:
    language = F.coalesce(F.col("language"), F.lit("")) if "language" in files.columns else F.coalesce(language_of(F.col("path").cast("string")), F.lit(""))
    columns = [c.split()[0] for c in shape.split(", ")]
    path = files.schema["path"].dataType.simpleString()
    return files.select("path", F.when(language.isin("", "unknown"), "typescript").otherwise(language).alias("language"), F.col("content").cast("string").alias("content")).mapInPandas(_scanned(rows, columns), f"path {path}, {shape}")


def _symbol_rows(content: str, language: str) -> Iterator[tuple]:
    _, symbols, _ = structure(content, language)
    line = _lines(content)
    for s in symbols:
        yield s.pos, s.parent, s.kind, s.name, s.at, s.end, line(s.at), line(max(s.at, s.end - 1)), s.named_at, content[s.at : s.body].strip(), s.doc, s.exported, content[s.at : s.end]


def symbol_tree(files: DataFrame, texts: bool = False) -> DataFrame:
    """Symbols of files (path, content and, if there, language), nested: pos, parent (-1 at the top), kind, name, range in characters and lines, signature, documentation, visibility, modifiers, exported.

    Strings, comments, templates and regular expressions hold no symbols. Visibility
    and modifiers are those whose word the symbol's text has. A null or empty file has no
    symbols; what a file leaves open ends with it. ``texts`` keeps each symbol's text.
    """
    shape = "pos int, parent int, kind string, name string, at long, end long, line int, end_line int, named_at long, head string, doc string, exported boolean, text string"
    rows = _apply(files, _symbol_rows, shape)
    low = F.lower("text")
    seen = lambda w: F.contains(low, F.lit(w))
    visibility = F.when(seen("private"), "private").when(seen("protected"), "protected").when(seen("internal"), "internal").otherwise("public")
    modifiers = F.filter(F.array(*map(F.lit, ("async", "static", "readonly", "abstract"))), lambda w: F.contains(low, w))
    first = F.split("text", "\n")[0]
    signature = F.when((F.col("head") != "") & F.contains("text", F.lit("{")), F.col("head")).when(F.length(first) > 100, F.concat(F.substring(first, 1, 100), F.lit("..."))).otherwise(first)
    out = rows.select("path", "pos", "parent", "kind", "name", "at", "end", "line", "end_line", "named_at", signature.alias("signature"), _cleaned(F.col("doc")).alias("documentation"), visibility.alias("visibility"), modifiers.alias("modifiers"), "exported", *["text"] * texts)
    return out


def _cleaned(doc: Column) -> Column:
    quoted = F.trim(F.regexp_replace(doc, r"(?s)^[rRuU]?(\"\"\"|''')(.*?)(\"\"\"|''')?$", "$2"))
    return F.when(doc.startswith("/"), clean_comment(doc)).when(doc.startswith("##"), F.trim(F.regexp_replace(doc, r"^#+\s?", ""))).otherwise(quoted)


def _doc_rows(content: str, language: str) -> Iterator[tuple]:
    _, _, docs = structure(content, language)
    line = _lines(content)
    for t, symbol in docs:
        yield line(t.at), line(t.end - 1), t.text, symbol


def doc_comments(files: DataFrame) -> DataFrame:
    """path, line, end_line, text, symbol of all doc comments; the symbol is what is declared right behind, else null."""
    rows = _apply(files, _doc_rows, "line int, end_line int, text string, symbol string")
    return rows.withColumn("text", _cleaned(F.col("text")))


def _use_rows(content: str, language: str) -> Iterator[tuple]:
    found, symbols, _ = structure(content, language)
    solid = [t for t in found if t.kind not in ("comment", "line")]
    names = {s.named_at for s in symbols}
    line = _lines(content)
    for i, t in enumerate(solid):
        if t.kind != "word" or t.text in RESERVED or t.at in names or t.text[0] in "@#":
            continue
        before = solid[i - 1].text if i else ""
        owner = solid[i - 2].text if before in (".", "?.") and i > 1 and solid[i - 2].kind == "word" else None
        yield t.text, t.at, line(t.at), before in (".", "?."), owner, i + 1 < len(solid) and solid[i + 1].text == "(", before in (":", "extends", "implements", "as", "new", "->", "instanceof")


def name_uses(files: DataFrame) -> DataFrame:
    """path, name, at, line, member (behind a dot), owner (the word before the dot), call, typed of every word that is used, not declared."""
    return _apply(files, _use_rows, "name string, at long, line int, member boolean, owner string, call boolean, typed boolean")


def _import_rows(content: str, language: str) -> Iterator[tuple]:
    for k, r in enumerate(bindings(list(tokens(content, language)), language)):
        yield k, *r


def import_bindings(files: DataFrame) -> DataFrame:
    """path, pos, source, imported (* for all), local, again (exported again) of every imported name."""
    return _apply(files, _import_rows, "pos int, source string, imported string, local string, again boolean")


def tree_exports(tree: DataFrame) -> DataFrame:
    """path, pos, name, is_default, is_type_only of what modules export, from their symbols at the top."""
    own = tree.filter("parent < 0 AND exported")
    return own.select("path", "pos", "name", F.col("signature").rlike(r"^export\s+default\b").alias("is_default"), F.col("kind").isin("interface", "type").alias("is_type_only"))


def module_schema(tree: DataFrame) -> DataFrame:
    """module, key, kind, parent, line, end_line, documentation, visibility: a module's definitions by name, those one level down by parent.name; of equal keys the last counts."""
    above = tree.select("path", F.col("pos").alias("parent"), F.col("name").alias("owner"), F.col("parent").alias("above"))
    near = tree.join(above, ["path", "parent"], "left").filter("parent < 0 OR above < 0")
    rows = near.select(F.col("path").alias("module"), "pos", "name", "kind", F.col("owner").alias("parent"), F.when(F.col("parent") < 0, 0).otherwise(1).alias("depth"), "line", "end_line", "documentation", "visibility")
    return module_definitions(rows).select("module", "key", "kind", "parent", "line", "end_line", "documentation", "visibility")


def source_chunks(files: DataFrame, least: int = 50) -> DataFrame:
    """id, path, level, symbol, content: of each file (path, content) what it imports and declares, its symbols and its doc comments, those of at least ``least`` tokens."""
    context = files.select(hash_id(F.col("path"), F.lit("file"), F.lit("context")).alias("id"), "path", F.lit("file").alias("level"), F.lit(None).cast("string").alias("symbol"), file_context(F.col("content")).alias("content"))
    symbols = symbol_chunks(symbol_tree(files, texts=True), least).select("id", "path", F.lit("symbol").alias("level"), "symbol", "content")
    docs = doc_comments(files).filter(estimate_tokens(F.col("text")) >= least)
    said = docs.select(hash_id(F.col("path"), F.lit("comment"), F.col("line").cast("string")).alias("id"), "path", F.lit("comment").alias("level"), "symbol", F.col("text").alias("content"))
    return context.filter("content <> ''").unionByName(symbols).unionByName(said)


def schema_failures(files: DataFrame) -> DataFrame:
    """path, reason of the files (path, content) that no schema can be built of: empty ones, and those without a symbol."""
    there = symbol_tree(files).select("path", F.lit(True).alias("known")).distinct()
    rows = files.select("path", (F.coalesce(F.length(F.trim(F.col("content").cast("string"))), F.lit(0)) == 0).alias("empty")).join(there, "path", "left")
    return rows.filter("empty OR known IS NULL").select("path", F.when(F.col("empty"), "empty").otherwise("no symbols").alias("reason"))
