"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from stratalith.functions import scoring, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.tokenize(F.lit("The quick, brown-fox GETS über it")), ["quick", "brown", "fox", "gets", "ber"]),
        (lambda: text.estimate_tokens(F.lit("")), 0),
        (lambda: text.estimate_tokens(F.lit("abcde")), 2),
        (lambda: text.estimate_tokens(F.lit("\U0001f600\U0001f600\U0001f600")), 2),
        (lambda: text.truncate_to_tokens(F.lit("hello wide world"), 2), "hello"),
        (lambda: text.truncate_to_tokens(F.lit("hello"), 2), "hello"),
        (lambda: text.truncate_to_tokens(F.lit("abcdefghijkl"), 2), "abcdefgh"),
        (lambda: text.truncate_to_tokens(F.lit("abc"), 0), ""),
        (lambda: text.clean_comment(F.lit("/** Adds.\n * Twice\n */")), "Adds.\nTwice"),
        (lambda: text.is_doc_comment(F.lit("/// x")), True),
        (lambda: text.strip_comments(F.lit("a // b\nc /* d\n e */ f")), "a \nc  f"),
        (lambda: text.resolve_import(F.lit("../x/./y"), F.lit("src/a/b.ts")), "src/x/y"),
        (lambda: text.resolve_import(F.lit("react"), F.lit("src/a/b.ts")), "react"),
        (lambda: text.module_path(F.lit("/w/p/src/a.ts"), "/w/p"), "src/a.ts"),
        (lambda: text.module_path(F.lit("/w/p"), "/w/p"), "index"),
        (lambda: text.module_path(F.lit("/a/b/c/d/e.ts"), "/w"), "c/d/e.ts"),
        (lambda: text.qualified_name(F.lit("src/util.test.ts"), F.lit("f")), "util.test.f"),
        (lambda: text.decode_uri_path(F.lit("file:///c%20d/a+b")), "/c d/a+b"),
        (lambda: text.slugify(F.lit("Hello, World!")), "hello-world"),
        (lambda: text.sanitize_id(F.lit("--")), "node"),
        (lambda: text.truncate(F.lit("abcdefgh"), 6), "abc..."),
        (lambda: text.escape_markdown(F.lit("a|<b>")), "a\\|&lt;b&gt;"),
        (lambda: text.summarize_diff(F.lit("diff --git a/x b/x\n+a\n-b\n+c")), "1 files (+2/-1)"),
        (lambda: text.parse_spec_ids(F.lit("A-1, B-2;; C ")), ["A-1", "B-2", "C"]),
        (lambda: text.auto_spec_id(F.lit("users can log in"), F.lit(3)), "USERS-CAN-LOG"),
        (lambda: text.normalize_params(F.lit("a: int , b")), "a: int, b"),
        (lambda: text.normalize_interface_body(F.lit("b: x; a: y\n// no")), "a: y; b: x"),
        (lambda: text.format_bytes(F.lit(1536)), "1.5 KB"),
        (lambda: text.format_bytes(F.lit(0)), "0 Bytes"),
        (lambda: text.parse_ram(F.lit("2GB")), 2.0 * (1 << 30)),
        (lambda: text.parse_ram(F.lit("much")), 0.0),
        (lambda: text.language_of(F.lit("a/b.PY")), "python"),
        (lambda: text.language_of(F.lit("a/b")), "typescript"),
        (lambda: text.matches_query(F.lit("computeDiff"), "cdf"), True),
        (lambda: text.matches_query(F.lit("computeDiff"), "xyz"), False),
        (lambda: text.is_watch_excluded(F.lit("a/node_modules/b")), True),
        (lambda: text.symbol_id(F.lit("file:///a/b.ts"), F.lit("f"), F.lit("C")), "a.b.ts:C#f"),
        (lambda: scoring.round2(F.lit(1.005)), 1.0),
        (lambda: scoring.complexity_level(F.lit(8)), "complex"),
        (lambda: scoring.level_jump(F.lit("simple"), F.lit("complex")), 2),
        (lambda: scoring.impact_level(F.lit(1), F.lit(0), F.lit(5)), "critical"),
        (lambda: scoring.impact_level(F.lit(0), F.lit(0), F.lit(0)), "none"),
        (lambda: scoring.type_direction(F.lit("a"), F.lit("a | b")), "contravariant"),
        (lambda: scoring.type_direction(F.lit("a | b | c"), F.lit("a | b")), "covariant"),
        (lambda: scoring.type_direction(F.lit("a"), F.lit("z")), "invariant"),
        (lambda: scoring.type_direction(F.lit("a"), F.lit("a")), None),
        (lambda: scoring.type_safe(F.lit("input"), F.lit("contravariant")), True),
        (lambda: scoring.suggested_cache_limit(F.lit(9 << 30)), 5 << 30),
        (lambda: vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), 0.0),
        (lambda: vectors.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))), 5.0),
        (lambda: vectors.normalize(F.array(F.lit(3.0), F.lit(4.0))), [0.6, 0.8]),
        (lambda: vectors.hybrid_score(F.lit(1.0), F.lit(0.0)), 0.7),
    ],
)
def test_column(spark, column, want):
    assert one(spark, column()) == want


def test_hash_id(spark):
    import hashlib

    assert one(spark, text.hash_id(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a:b").hexdigest()[:16]


def test_highlight(spark):
    assert one(spark, text.highlight(["foo"], F.lit("a\n Foo bar\nfoo"))) == ["**Foo** bar", "**foo**"]


def test_expand_query():
    assert text.expand_query("delete file") == ["delete file", "remove file", "destroy file", "drop file", "clear file"]


def test_split_diff(spark):
    got = one(spark, text.split_diff(F.lit("diff --git a/x b/x\n+1\ndiff --git a/y b/y\n-2")))
    assert [r["path"] for r in got] == ["x", "y"]
