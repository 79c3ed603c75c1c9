"""Column functions for bands, scores and type comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def round2(c: Column) -> Column:
    """Half up to two decimals on doubles, as floor(100 x + 0.5) / 100."""
    return F.floor(c.cast("double") * 100 + 0.5) / 100


def round1(c: Column) -> Column:
    return F.floor(c.cast("double") * 10 + 0.5) / 10


def percent(part: Column, whole: Column, empty: float = 100.0) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(empty))


def banded(c: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first band whose upper end isn't below c."""
    out = F.when(c <= bands[0][0], F.lit(bands[0][1]))
    for most, name in bands[1:]:
        out = out.when(c <= most, F.lit(name))
    return out.otherwise(F.lit(rest))


# Names of complexity levels, in order.
LEVELS = ["trivial", "simple", "moderate", "complex", "galaxy-brain"]


def complexity_level(branches: Column) -> Column:
    return banded(branches, [(1, "trivial"), (3, "simple"), (7, "moderate"), (15, "complex")], "galaxy-brain")


def level_jump(before: Column, after: Column) -> Column:
    """Steps from one complexity level to another."""
    levels = F.array(*[F.lit(x) for x in LEVELS])
    return F.array_position(levels, after) - F.array_position(levels, before)


def impact_level(direct: Column, transitive: Column, exports: Column) -> Column:
    return (
        F.when(exports >= 5, "critical")
        .when((direct >= 10) | (exports >= 2), "high")
        .when((direct >= 3) | (transitive >= 10), "medium")
        .when(direct >= 1, "low")
        .otherwise("none")
    )


def importance_score(dependents: Column, entry: Column, public: Column, of_entry: Column, cyclomatic: Column, lines: Column) -> Column:
    """0 to 10, from dependents, roles, complexity and size."""
    points = lambda c, p: F.when(c, F.lit(p)).otherwise(F.lit(0.0))
    score = F.least(dependents * 1.5, F.lit(4.0)) + points(entry, 2.0) + points(public, 1.0) + points(of_entry, 0.5)
    score = score + F.when(cyclomatic > 20, 1.5).when(cyclomatic > 10, 1.0).when(cyclomatic > 5, 0.5).otherwise(0.0)
    score = score + F.when(lines > 500, 1.0).when(lines > 200, 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score - points((dependents == 0) & ~entry, 0.5)))


def missing_doc_severity(exported: Column, visibility: Column, complexity: Column, kind: Column) -> Column:
    points = lambda c, p: F.when(F.coalesce(c, F.lit(False)), F.lit(p)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.5 + points(exported, 0.2) + points(visibility == "public", 0.1) + points(complexity > 5, 0.1) + points(kind.isin("class", "interface"), 0.1))


def completion_relevance(same_file: Column, line_distance: Column, deprecated: Column, kind: Column) -> Column:
    near = F.when(same_file, 100 + F.greatest(F.lit(0), 50 - line_distance)).otherwise(0)
    return near + F.when(deprecated, 0).otherwise(20) + F.when(kind.isin("function", "class"), 10).otherwise(0)


def recommendation_tier(score: Column) -> Column:
    return F.when(score > 80, "great").when(score >= 50, "good").otherwise("marginal")


def floor_days(now: Column, ts: Column) -> Column:
    """Whole days of age."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000))


def union_parts(c: Column) -> Column:
    return F.transform(F.split(c, r"\|"), strip)


def _wider(narrow: Column, wide: Column) -> Column:
    """Whether ``wide`` adds to a union that ``narrow`` is or is part of, by the texts."""
    a, b = union_parts(narrow), union_parts(wide)
    both = F.contains(narrow, F.lit("|")) & F.contains(wide, F.lit("|"))
    return (~F.contains(narrow, F.lit("|")) & F.contains(wide, F.lit("|")) & F.contains(wide, narrow)) | (both & (F.size(F.array_except(a, b)) == 0) & (F.size(b) > F.size(a)))


def type_widened(before: Column, after: Column) -> Column:
    gains = lambda w: ~F.contains(before, F.lit(w)) & F.contains(after, F.lit(w))
    return _wider(before, after) | gains("null") | gains("undefined")


def type_narrowed(before: Column, after: Column) -> Column:
    return type_widened(after, before)


def type_direction(before: Column, after: Column) -> Column:
    """Null if equal; contravariant if added or widened, covariant if removed or narrowed, else invariant."""
    return (
        F.when(before.eqNullSafe(after), F.lit(None).cast("string"))
        .when(before.isNull(), "contravariant")
        .when(after.isNull(), "covariant")
        .when(type_widened(before, after), "contravariant")
        .when(type_narrowed(before, after), "covariant")
        .otherwise("invariant")
    )


def type_breaking(direction: Column) -> Column:
    return F.coalesce(direction.isin("covariant", "invariant"), F.lit(False))


def type_safe(position: Column, direction: Column) -> Column:
    """Inputs may widen, outputs may narrow."""
    return ((position == "input") & (direction == "contravariant")) | ((position == "output") & (direction == "covariant"))


def model_score(size: Column, available: Column, gpu: Column, model_gpu: Column, model_cpu: Column, recommended: Column) -> Column:
    """How well a model fits a machine, 0 to 100: it needs 2.5 times its size, and 70 % of the memory is there for it; compared in whole tenths of bytes, so that equal is equal."""
    need = size * 25
    fit = 100 - F.when(need > available * 7, 30).otherwise(0) - F.when(need > available * 10, 50).otherwise(0) + F.when(model_gpu & gpu, 10).otherwise(0)
    bonus = F.when(size < 200_000_000, 5).when(size < 500_000_000, 3).otherwise(0) + F.when(recommended, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(~model_cpu & ~gpu, 0).otherwise(fit) + bonus))


def suggested_cache_limit(ram: Column) -> Column:
    """Bytes by steps of memory."""
    gb = 1 << 30
    return F.when(ram >= 32 * gb, 20 * gb).when(ram >= 16 * gb, 10 * gb).when(ram >= 8 * gb, 5 * gb).when(ram >= 4 * gb, 2 * gb).otherwise(gb)
