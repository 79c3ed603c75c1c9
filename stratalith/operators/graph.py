"""Dependency and call graphs: edges from imports, callers, closure, paths, cycles, order, ranking.

Fixed depths are unrolled joins. Unbounded ones loop over frontiers that hold only
new rows; each turn cuts its lineage with a reliable checkpoint and stops when the
frontier is empty. Only counts come to the driver. ``most`` bounds the turns where it
is given: rows that are left then raise.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, few
from ..functions import text
from ..functions.scoring import impact_level, importance_score

# Extensions tried for an import, in order.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ""]

# Patterns of imports by language, group 1 the module.
IMPORT_PATTERNS = {
    "typescript": [
        r"import\s+(?:type\s+)?(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+['\"]([^'\"]+)['\"]",
        r"import\s+['\"]([^'\"]+)['\"]",
        r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"export\s+(?:\{[^}]*\}\s+)?from\s+['\"]([^'\"]+)['\"]",
    ],
    "python": [r"from\s+([\w.]+)\s+import", r"import\s+([\w.]+)"],
    "rust": [r"use\s+([\w:]+)", r"mod\s+(\w+)"],
    "go": [r"import\s+(?:\(\s*)?[\"']([^\"']+)[\"']", r"import\s+\w+\s+[\"']([^\"']+)[\"']"],
}

# File names of entry points.
ENTRY_POINT = r"^(index\.[tj]sx?|main\.[tj]sx?|app\.[tj]sx?|server\.[tj]sx?|cli\.[tj]sx?|extension\.[tj]sx?|__main__\.py|main\.py|main\.rs|lib\.rs|main\.go)$"


def is_entry_point(path: Column) -> Column:
    return text.last_segment(path).rlike(ENTRY_POINT)


def extract_imports(content: Column, language: Column) -> Column:
    """All modules that a text imports, pattern by pattern, repeated ones kept."""
    found = F.array().cast("array<string>")
    for name, patterns in IMPORT_PATTERNS.items():
        own = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])
        match = language.isin("typescript", "javascript") if name == "typescript" else language == name
        found = F.when(match, F.filter(own, lambda m: m != "")).otherwise(found)
    return found


def resolve_imports(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(importer, pos, target) of relative and rooted imports (importer, pos, source) that name a file (path).

    Each extension is tried on the path, then on its index file; the first hit counts.
    """
    local = imports.filter(F.col("source").startswith(".") | F.col("source").startswith("/"))
    rooted = F.when(F.col("source").startswith("/"), F.concat(F.lit(root.rstrip("/")), F.col("source"))).otherwise(text.resolve_import(F.col("source"), F.col("importer")))
    tries = F.array(*[F.struct(F.lit(2 * i + k).alias("rank"), F.concat(F.col("base"), F.lit(("/index" if k else "") + e)).alias("path")) for i, e in enumerate(EXTENSIONS) for k in (0, 1)])
    tried = local.withColumn("base", rooted).select("importer", "pos", F.explode(tries).alias("t")).select("importer", "pos", "t.rank", "t.path")
    return tried.join(files.select("path").distinct(), "path").groupBy("importer", "pos").agg(F.min_by("path", "rank").alias("target"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, imports) with the distinct names of parallel edges (src, dst, pos, imports), in order of place; one edge keeps its list.

    A name's first place is found before names are gathered, so that a list is as
    long as the names, not the edges.
    """
    first = edges.select("src", "dst", "pos", F.posexplode_outer("imports").alias("at", "name")).groupBy("src", "dst", "name").agg(F.min(F.struct("pos", "at")).alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("first", "name")))), lambda x: x["name"])
    lists = first.groupBy("src", "dst").agg(names.alias("names"))
    alone = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("imports").alias("own"))
    return alone.join(lists, ["src", "dst"]).select("src", "dst", F.when(F.col("n") > 1, F.col("names")).otherwise(F.col("own")).alias("imports"))


def call_graph(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Callable nodes (id, callers, callees, is_entry, is_leaf) of symbols (id, kind) under calls (src, dst)."""
    nodes = symbols.filter(F.col("kind").isin("function", "method")).select("id")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return nodes.join(into, "id", "left").join(out, "id", "left").select("id", n("callers").alias("callers"), n("callees").alias("callees"), (n("callers") == 0).alias("is_entry"), (n("callees") == 0).alias("is_leaf"))


def direct_callers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, caller), a row for each edge."""
    return edges.join(seeds, F.col("dst") == F.col("seed")).select("seed", F.col("src").alias("caller"))


def transitive_callers(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, caller) reached backwards in up to ``depth`` steps beyond the direct callers, without them and the seed."""
    direct = direct_callers(edges, seeds).distinct()
    known, frontier, found = seeds.select("seed", F.col("seed").alias("caller")).unionByName(direct), direct, None
    for _ in range(depth):
        step = frontier.join(edges, F.col("caller") == F.col("dst")).select("seed", F.col("src").alias("caller")).distinct()
        frontier = step.join(known, ["seed", "caller"], "left_anti")
        known = known.unionByName(frontier)
        found = frontier if found is None else found.unionByName(frontier)
    return found


def analyze_impact(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """seed, direct, transitive, modules, exports, blast_radius, level; nodes: id, module, exported.

    A caller that is no node belongs to the module before its colon, if it has one.
    """
    direct, far = direct_callers(edges, seeds), transitive_callers(edges, seeds, depth)
    both = direct.select("seed", "caller", F.lit(1).alias("d")).unionByName(far.select("seed", "caller", F.lit(0).alias("d")))
    known = both.join(nodes.withColumnRenamed("id", "caller"), "caller", "left")
    module = F.coalesce("module", F.when(F.contains("caller", F.lit(":")), F.split("caller", ":")[0]))
    counted = known.groupBy("seed").agg(F.sum("d").alias("direct"), F.sum(1 - F.col("d")).alias("transitive"), F.count_distinct(module).alias("modules"), F.count_distinct(F.when(F.col("exported"), F.col("caller"))).alias("exports"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = seeds.select("seed").distinct().join(counted, "seed", "left").select("seed", n("direct"), n("transitive"), n("modules"), n("exports"))
    return out.withColumn("blast_radius", F.col("direct") + F.col("transitive")).withColumn("level", impact_level(F.col("direct"), F.col("transitive"), F.col("exports")))


def impact_summary(impact: DataFrame) -> DataFrame:
    """One row: seeds by level, total blast radius, the widest seed (smallest on ties, null if all are 0)."""
    n = lambda x: F.count_if(F.col("level") == x).alias(x)
    widest = F.min(F.when(F.col("blast_radius") > 0, F.struct((-F.col("blast_radius")).alias("b"), F.col("seed"))))
    return impact.agg(*[n(x) for x in ("critical", "high", "medium", "low", "none")], F.coalesce(F.sum("blast_radius"), F.lit(0)).alias("total_blast"), widest["seed"].alias("widest"))


def _within(turn: int, most: int | None) -> None:
    if most is not None and turn > most:
        raise ValueError(f"rows are left after {most} turns")


def _near(last: DataFrame, ball: DataFrame, each: int) -> tuple[DataFrame, int, DataFrame]:
    """What of ball (src, dst, step) starts where last (src) ends, the number of rows that both make when joined, and (src, slices) of sources that alone make more than ``each``."""
    ends = checkpointed(last.groupBy("src").agg(F.count("*").alias("ins")))
    near = ball.join(few(ends), "src")
    sources = checkpointed(near.groupBy("src").agg(F.max("ins").alias("ins"), F.count("*").alias("outs")).withColumn("made", F.col("ins") * F.col("outs")))
    hot = sources.filter(F.col("made") > each).select("src", F.least("ins", F.ceil(F.col("made") / each)).cast("int").alias("slices"))
    return near.drop("ins"), sources.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0], few(hot)


def _met(last: DataFrame, near: DataFrame, hot: DataFrame, key: str, parts: int) -> DataFrame:
    """last joined with near by src; rows of last that end at a hot source are dealt to slices, each of which gets that source's links."""
    slices = F.coalesce("slices", F.lit(1))
    links = near.join(hot, "src", "left").select(*near.columns, F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    ends = last.join(hot, "src", "left").select(*last.columns, F.pmod(F.xxhash64(key), slices).cast("int").alias("slice"))
    return links.repartition(parts, "src", "slice").join(ends.repartition(parts, "src", "slice"), ["src", "slice"])


def _spread_out(known: DataFrame, edges: DataFrame, key: str, most: int | None, at: int = 0, whole: bool = False, turns: int = 3, each: int = 250_000, back: bool = False) -> DataFrame:
    """known (key, id, level and, if there, path; all of level ``at``) with all that edges (src, dst) reach, at its first level, by the smallest path there.

    A turn joins the last level with the edges and folds what is new into the
    known rows in one aggregation, of plain numbers where no paths are kept. What it
    makes is counted by source before, and rows are dealt to partitions of about
    ``each``, so that what a task holds doesn't grow with them; many rows that end at
    one source are dealt, too. While a level can't fill a partition, several turns
    share a plan and a checkpoint. ``whole``: each source of an edge is a key, so that
    known rows are links of up to ``at`` steps themselves; where joining them makes
    few rows for those known, they stand in for the edges and double the levels.
    Paths grow at their end, or, ``back`` along edges turned round, at their front.
    """
    paths = ["path"] if "path" in known.columns else []
    edges = edges.withColumn("step", F.lit(1))
    widest = edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    known = checkpointed(known)
    rows = new = known.count()
    parts = lambda n: max(1, -(-n // each))

    def last() -> DataFrame:
        return known.filter(F.col("level") == at).select(key, F.col("id").alias("src"), *paths)

    def folded(met: DataFrame, n: int) -> DataFrame:
        step = met.select(key, F.col("dst").alias("id"), (F.lit(at) + F.col("step")).alias("level"), *[(F.concat(F.array("dst"), "path") if back else F.concat("path", F.array("dst"))).alias("path")] * bool(paths))
        both = known.unionByName(step).repartition(n, key, "id").groupBy(key, "id")
        return both.agg(F.min(F.struct("level", "path")).alias("best")).select(key, "id", "best.level", "best.path") if paths else both.agg(F.min("level").alias("level"))

    while new:
        if not whole and rows + new * sum(widest**i for i in range(1, turns + 1)) <= each:
            for _ in range(turns):
                known, at = folded(last().join(edges, "src"), 1), at + 1
        else:
            steps = at if whole else 1
            near, made, hot = _near(last(), known.select(F.col(key).alias("src"), F.col("id").alias("dst"), F.col("level").alias("step")) if whole else edges, each)
            if steps > 1 and made > 4 * rows:
                steps, (near, made, hot) = 1, _near(last(), edges, each)
            known, at = folded(_met(last(), near, hot, key, parts(made + new)), parts(rows + made)), at + steps
        known = checkpointed(known)
        rows, new, deepest = known.agg(F.count("*"), F.count_if(F.col("level") == at), F.max("level")).first()
        _within(deepest, most)
    return known


def transitive_closure(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, id, level): everything reachable, at its first level; a seed itself only over a cycle."""
    edges, seeds = checkpointed(edges.select("src", "dst").distinct()), seeds.select("seed").distinct()
    own = checkpointed(edges.join(seeds, F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("id"), F.lit(1).alias("level")))
    whole = own.count() == edges.filter("src IS NOT NULL").count()
    return _spread_out(own, edges, "seed", most, at=1, whole=whole)


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(start, goal, path) for pairs (start, goal) with a path; of equal ones the smallest predecessors."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    starts, goals = pairs.agg(F.count_distinct("start"), F.count_distinct("goal")).first()
    back = goals < starts  # from the side with fewer ends; the smallest of equal paths is the same from either
    key, far = ("goal", "start") if back else ("start", "goal")
    first = pairs.select(key, F.col(key).alias("id"), F.lit(0).alias("level"), F.array(key).alias("path")).distinct()
    found = _spread_out(first, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else edges, key, most, back=back)
    return pairs.join(found.select(key, F.col("id").alias(far), "path"), ["start", "goal"])


def _grown(known: DataFrame, more: DataFrame, turn: int, each: int = 8) -> DataFrame:
    """known with more rows; written anew every few turns only, so that neither files nor plans pile up."""
    both = known.unionByName(more)
    return both if turn % each else checkpointed(both)


def cycle_members(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, cycle) of every strongly connected component with several members; cycle is its smallest id.

    Nodes without a way in or out go first, turn by turn, as they can't be on a
    cycle. In what is left, each node takes the smallest id that reaches it and the
    smallest that it reaches; where both are the same, that is its component, which
    is done; the rest goes on.
    """
    left = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())
    done = None
    for turn in count(1):
        while True:
            n = left.count()
            left = checkpointed(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.count() == n:
                break
        if not n:
            break
        _within(turn, most)
        found = _colors(left, "src", "dst", most).withColumnRenamed("color", "a").join(_colors(left, "dst", "src", most).withColumnRenamed("color", "b"), "id")
        found = checkpointed(found)
        own = found.filter("a = b").select("id", F.col("a").alias("cycle"))
        done = own if done is None else done.unionByName(own)
        # a component lies within one color of either direction, so that edges between colors go
        pair = found.select("id", "a", "b")
        ends = left.join(pair.select(F.col("id").alias("src"), F.col("a").alias("a1"), F.col("b").alias("b1")), "src").join(pair.select(F.col("id").alias("dst"), F.col("a").alias("a2"), F.col("b").alias("b2")), "dst")
        left = checkpointed(ends.filter("a1 = a2 AND b1 = b2 AND a1 <> b1").select("src", "dst"))
    if done is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("cycle")).limit(0)
    return done.join(done.groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1"), "cycle", "left_semi").select("id", "cycle")


def _colors(edges: DataFrame, start: str, end: str, most: int | None) -> DataFrame:
    """(id, color): the smallest id from which edges lead to each node, itself included."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    colors = checkpointed(nodes.withColumn("color", F.col("id")))
    for turn in count(1):
        sent = colors.join(edges, F.col("id") == F.col(start)).groupBy(F.col(end).alias("to")).agg(F.min("color").alias("got"))
        new = checkpointed(colors.join(sent, F.col("id") == F.col("to"), "left").select("id", "color", F.least("color", F.coalesce("got", "color")).alias("now")))
        settled = new.filter("now < color").isEmpty()
        colors = new.select("id", F.col("now").alias("color"))
        if settled:
            break
        _within(turn, most)
    return colors


def mark_circular(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """edges with in_cycle: both ends in the same cycle (id, cycle)."""
    side = lambda c: cycles.select(F.col("id").alias(c), F.col("cycle").alias(f"{c}_cycle"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").withColumn("in_cycle", F.coalesce(F.col("src_cycle") == F.col("dst_cycle"), F.lit(False))).drop("src_cycle", "dst_cycle")


def has_cycles(edges: DataFrame) -> bool:
    return not cycle_members(edges).isEmpty()


def topological_levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): a node's level is its longest way from a node without predecessors; raises on cycles."""
    left, links, out = checkpointed(nodes.select("id").distinct()), checkpointed(edges.select("src", "dst").distinct()), None
    for level in count():
        free = checkpointed(left.join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            out = free if out is None else out
            break
        _within(level + 1, most)
        out = free if out is None else _grown(out, free, level)
        left = checkpointed(left.join(free, "id", "left_anti"))
        links = checkpointed(links.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
    if not left.isEmpty():
        raise ValueError("the graph has cycles")
    return out


def file_importance(files: DataFrame, edges: DataFrame) -> DataFrame:
    """path, dependents, dependencies, score of files (path, is_entry, has_api, cyclomatic, lines) under edges (src, dst)."""
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("dependents"))
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("dependencies"))
    of_entry = edges.join(files.filter("is_entry").select(F.col("path").alias("src")), "src").select(F.col("dst").alias("path"), F.lit(True).alias("of_entry")).distinct()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = files.join(into, "path", "left").join(out, "path", "left").join(of_entry, "path", "left")
    score = importance_score(n("dependents"), F.col("is_entry"), F.col("has_api"), F.coalesce("of_entry", F.lit(False)), F.col("cyclomatic"), F.col("lines"))
    return rows.select("path", n("dependents").alias("dependents"), n("dependencies").alias("dependencies"), score.alias("score"))


def undocumented_important(importance: DataFrame, documented: DataFrame, limit: int = 20, least: float = 0.0) -> DataFrame:
    """The most important files without documents, with a priority: twice the limit first, then the threshold, then the limit."""
    top = importance.join(documented.select("path").distinct(), "path", "left_anti").orderBy(F.desc("score"), "path").limit(2 * limit)
    band = F.when(F.col("score") >= 7, "critical").when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "medium").otherwise("low")
    return top.filter(F.col("score") >= least).orderBy(F.desc("score"), "path").limit(limit).withColumn("priority", band)


def participants(edges: DataFrame) -> DataFrame:
    """Ends of edges (src, dst, pos) in order of first appearance: id, first."""
    ends = edges.select(F.posexplode(F.array("src", "dst")).alias("side", "id"), "pos")
    return ends.groupBy("id").agg(F.min(F.col("pos") * 2 + F.col("side")).alias("first")).orderBy("first")
