"""Snapshot diffs: modules, exports, parameters, signatures; classification and summary.

Two versions meet in one full outer join on their key; what changed is a CASE on
the joined row, so that a diff is one shuffle of either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import type_breaking, type_direction


def change_type(before: str, after: str):
    """added, removed or modified by which side is there."""
    return F.when(F.col(before).isNull(), "added").when(F.col(after).isNull(), "removed").otherwise("modified")


def diff_exports(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, name, change, breaking, semver of exports (path, name, signature, description, deprecated) that differ.

    A changed return or parameter is diff_parameters' part; here a removal is
    breaking, a deprecation minor, any other change a patch. Of repeated keys one
    per side is taken.
    """
    cols = ["signature", "description", "deprecated"]
    side = lambda df, p: df.dropDuplicates(["path", "name"]).select("path", "name", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(before, "b").join(side(after, "a"), ["path", "name"], "full_outer")
    old, new = F.coalesce("b_deprecated", F.lit(False)), F.coalesce("a_deprecated", F.lit(False))
    kind = (
        F.when(F.col("b_here").isNull(), "added")
        .when(F.col("a_here").isNull(), "removed")
        .when(~old & new, "deprecated")
        .when(old & ~new, "undeprecated")
        .when(~F.col("b_signature").eqNullSafe(F.col("a_signature")) | ~F.col("b_description").eqNullSafe(F.col("a_description")), "modified")
    )
    out = both.withColumn("change", kind).filter("change IS NOT NULL")
    semver = F.when(F.col("change") == "removed", "major").when(F.col("change").isin("added", "deprecated"), "minor").otherwise("patch")
    return out.select("path", "name", "change", (F.col("change") == "removed").alias("breaking"), semver.alias("semver"), (~F.col("b_signature").eqNullSafe(F.col("a_signature")) & (F.col("change") == "modified")).alias("signature_changed"))


def diff_modules(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, breaking of modules that came or went."""
    both = before.select("path", F.lit(1).alias("b")).distinct().join(after.select("path", F.lit(1).alias("a")).distinct(), "path", "full_outer").filter("a IS NULL OR b IS NULL")
    return both.select("path", change_type("b", "a").alias("change"), F.col("a").isNull().alias("breaking"))


def diff_parameters(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, param, change, direction, breaking of parameters (symbol, param, pos, type, optional, default_value)."""
    cols = ["pos", "type", "optional", "default_value"]
    side = lambda df, p: df.select("symbol", "param", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(before, "b").join(side(after, "a"), ["symbol", "param"], "full_outer")
    common = F.col("b_here").isNotNull() & F.col("a_here").isNotNull()
    direction = F.when(common, type_direction(F.col("b_type"), F.col("a_type")))
    moved = common & (F.col("b_pos") != F.col("a_pos"))
    option = common & (F.col("b_optional") != F.col("a_optional"))
    change = F.when(F.col("a_here").isNull(), "removed").when(F.col("b_here").isNull(), "added").when(moved, "reordered").when(direction.isNotNull() | option, "modified")
    breaking = F.when(F.col("a_here").isNull(), True).when(F.col("b_here").isNull(), ~F.col("a_optional") & F.col("a_default_value").isNull()).otherwise(moved | (option & ~F.col("a_optional")) | type_breaking(direction))
    return both.select("symbol", "param", change.alias("change"), direction.alias("direction"), breaking.alias("breaking")).filter("change IS NOT NULL")


def diff_returns(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, direction, breaking of return types (symbol, type): widening one breaks its callers."""
    both = before.select("symbol", F.col("type").alias("b")).join(after.select("symbol", F.col("type").alias("a")), "symbol").withColumn("direction", type_direction(F.col("b"), F.col("a")))
    return both.filter("direction IS NOT NULL").select("symbol", "direction", (F.col("direction") == "contravariant").alias("breaking"))


def semantic_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """category, name, change of signatures (category, name, hash); exports have no hash to change, imports are left out."""
    side = lambda df, c: df.filter("category <> 'import'").select("category", "name", F.coalesce("hash", F.lit("")).alias(c))
    both = side(before, "b").join(side(after, "a"), ["category", "name"], "full_outer").filter("NOT b <=> a")
    changed = F.when(F.col("category") == "function", "signature-changed").otherwise("modified")
    return both.select("category", "name", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise(changed).alias("change"))


def diff_summary(changes: DataFrame, modules: DataFrame) -> DataFrame:
    """One row of counts over export changes and module changes."""
    both = changes.select("path", "change", "breaking", F.lit(False).alias("module")).unionByName(modules.select("path", "change", "breaking", F.lit(True).alias("module")))
    n = lambda c: F.count_if(F.col("change") == c)
    return both.agg(F.count("*").alias("total"), F.count_if("breaking").alias("breaking"), n("added").alias("additions"), n("removed").alias("removals"), n("modified").alias("modifications"), n("deprecated").alias("deprecations"), F.count_distinct("path").alias("modules_affected"))


def semver_bump(changes: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: major if anything breaks, minor for additions, patch for the rest, none for nothing."""
    both = changes.select("change", "breaking", "semver").unionByName(modules.select("change", "breaking", F.lit(None).cast("string").alias("semver")))
    found = both.agg(F.count("*").alias("n"), F.bool_or("breaking").alias("b"), F.bool_or((F.col("change") == "added") | (F.coalesce("semver", F.lit("")) == "minor")).alias("m"))
    return found.select(F.when(F.col("b"), "major").when(F.col("m"), "minor").when(F.col("n") > 0, "patch").otherwise("none").alias("bump"))


# Texts of what a change says about a symbol.
SENTENCES = {"added": "New export '%s'", "removed": "Export '%s' removed - BREAKING", "deprecated": "'%s' deprecated", "undeprecated": "'%s' undeprecated", "renamed": "'%s' renamed - BREAKING", "modified": "'%s' modified"}


def describe_changes(changes: DataFrame) -> DataFrame:
    """changes with a sentence each."""
    text = F.lit(None).cast("string")
    for kind, form in SENTENCES.items():
        text = F.when(F.col("change") == kind, F.format_string(form, F.col("name"))).otherwise(text)
    return changes.withColumn("description", text)


def changelog_sections(changes: DataFrame) -> DataFrame:
    """A row for every section that a change belongs to, by priority: breaking, deprecations, new, changes, other."""
    c = F.col("change")
    labels = F.array_compact(
        F.array(
            F.when(F.col("breaking"), F.struct(F.lit(1).alias("priority"), F.lit("Breaking Changes").alias("section"))),
            F.when(c == "deprecated", F.struct(F.lit(2).alias("priority"), F.lit("Deprecations").alias("section"))),
            F.when((c == "added") & ~F.col("breaking"), F.struct(F.lit(3).alias("priority"), F.lit("New Features").alias("section"))),
            F.when((c == "modified") & ~F.col("breaking"), F.struct(F.lit(4).alias("priority"), F.lit("Changes").alias("section"))),
        )
    )
    other = F.array(F.struct(F.lit(5).alias("priority"), F.lit("Other").alias("section")))
    return changes.withColumn("s", F.explode(F.when(F.size(labels) == 0, other).otherwise(labels))).select("path", "name", "change", "s.priority", "s.section")


def changes_by_module(changes: DataFrame) -> DataFrame:
    """path, first, names: the changes (path, pos, name) of each module, in the order of their place."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return changes.groupBy("path").agg(F.min("pos").alias("first"), F.transform(listed, lambda x: x["name"]).alias("names"))


def compare_flow(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, branch_delta, error_delta, new_errors, breaking of flow matrices (symbol, branches, error_paths, level, errors)."""
    from ..functions.scoring import level_jump

    cols = ["branches", "error_paths", "level", "errors"]
    side = lambda df, p: df.select("symbol", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    both = side(before, "b").join(side(after, "a"), "symbol", "full_outer")
    none = F.array().cast("array<string>")
    delta = lambda c: F.coalesce(f"a_{c}", F.lit(0)) - F.coalesce(f"b_{c}", F.lit(0))
    new = F.array_except(F.coalesce("a_errors", none), F.coalesce("b_errors", none))
    jump = F.coalesce(level_jump(F.col("b_level"), F.col("a_level")) >= 2, F.lit(False))
    return both.select("symbol", delta("branches").alias("branch_delta"), delta("error_paths").alias("error_delta"), new.alias("new_errors"), ((F.size(new) > 0) | jump).alias("breaking"))
