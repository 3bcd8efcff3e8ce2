"""Import graphs: degrees, dependents, reachability, components and their summaries.

Edges are (src, dst, kind): src imports dst.  Iterative operators advance a frontier by joins,
write each round to the shared folder, and end when a round finds nothing; no driver or single
task holds the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.paths import extension, has_component, parent
from ..plans.storage import materialize, release, shuffled

#: The edge kinds that are dependencies.
DEPENDENCY_KINDS = ("imports", "re-exports", "depends-on")


def edges_of(imports: DataFrame) -> DataFrame:
    """(src, dst, deferred) once per pair: an eager import of a target outweighs a deferred one."""
    return imports.groupBy("src", "dst").agg(F.bool_and("deferred").alias("deferred"))


def eager(edges: DataFrame) -> DataFrame:
    return edges.filter("NOT deferred")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges once each whose ends are both known nodes."""
    a, b = nodes.select(F.col("node").alias("src")).distinct(), nodes.select(F.col("node").alias("dst")).distinct()
    return edges.select("src", "dst", "kind").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "kind")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability) of every node; pairs count once a kind.

    One aggregation over both ends, combined before its shuffle, so a hub is one row a task.
    """
    e = edges.select("src", "dst", "kind").distinct()
    ends = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))).unionByName(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    total = F.col("fan_in") + F.col("fan_out")
    return d.withColumn("instability", F.when(total == 0, F.lit(0.0)).otherwise(F.col("fan_out") / total).cast("float"))


def top_fan_in(d: DataFrame, k: int) -> DataFrame:
    return d.filter("fan_in > 0").orderBy(F.desc("fan_in"), F.desc("fan_out"), "node").limit(k)


def top_fan_out(d: DataFrame, k: int) -> DataFrame:
    return d.filter("fan_out > 0").orderBy(F.desc("fan_out"), F.desc("fan_in"), "node").limit(k)


def unstable_hubs(d: DataFrame, fan_in: int = 5, percent: int = 75) -> DataFrame:
    return d.filter((F.col("fan_in") >= fan_in) & (F.floor(F.col("instability") * 100 + 0.5) >= percent))


def dependent_pairs(edges: DataFrame) -> DataFrame:
    """(node, dependent) once each, over dependency kinds; a hub's importers are rows, not one list."""
    return edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).select(F.col("dst").alias("node"), F.col("src").alias("dependent")).distinct()


def direct_dependents(edges: DataFrame) -> DataFrame:
    """(node, dependents): sorted importers as lists, for graphs whose hubs fit a row."""
    return dependent_pairs(edges).groupBy("node").agg(F.array_sort(F.collect_list("dependent")).alias("dependents"))


def dependent_counts(edges: DataFrame) -> DataFrame:
    e = edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).select("src", "dst").distinct()
    return e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))


def directory_dependencies(edges: DataFrame) -> DataFrame:
    """(src_dir, dst_dir, edges) between different directories; raw edges count."""
    e = edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).select(parent(F.col("src")).alias("src_dir"), parent(F.col("dst")).alias("dst_dir"))
    return e.filter("src_dir <> dst_dir").groupBy("src_dir", "dst_dir").agg(F.count(F.lit(1)).alias("edges"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None, by: list[str] | None = None) -> DataFrame:
    """(by..., node, hop): what seeds reach along src -> dst, seeds at hop 0."""
    by = by or []
    e = materialize(edges.select("src", "dst").distinct())
    frontier = materialize(seeds.select(*by, "node").distinct().withColumn("hop", F.lit(0)))
    seen = [frontier]
    hop = 0
    while rounds is None or hop < rounds:
        hop += 1
        known = reduce(DataFrame.unionByName, seen).select(*by, "node")
        step = frontier.join(e, F.col("node") == F.col("src")).select(*by, F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(known, [*by, "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if not frontier.take(1):
            release(frontier)
            break
        seen.append(frontier)
        if len(seen) > 8:  # keep plans and file lists short on long chains
            parts, seen = seen, [materialize(reduce(DataFrame.unionByName, seen))]
            for part in parts[:-1]:  # the last one is the frontier
                release(part)
    release(e)
    return reduce(DataFrame.unionByName, seen)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all that depends on the seeds, near or far, seeds excluded."""
    return spread(reverse(edges), seeds, None).filter("hop > 0").select("node")


def one_hop_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): unchanged files that import a changed one."""
    c = changed.select(F.col("node").alias("dst")).distinct()
    return edges.join(c, "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(changed, "node", "left_anti")


def impact(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, node, hop): for each changed file its dependents within depth, by fewest hops.

    Paths lead through other changed files, which are not reported themselves.
    """
    seeds = changed.select("node", F.col("node").alias("seed"))
    found = spread(reverse(edges), seeds, depth, ["seed"]).filter("hop > 0")
    return found.join(changed.select("node"), "node", "left_anti").select("seed", "node", "hop")


def neighbourhood(edges: DataFrame, centre: DataFrame, depth: int) -> DataFrame:
    """(node, hop): nodes within depth of the centre, direction aside."""
    return spread(edges.select("src", "dst").unionByName(reverse(edges)), centre, depth)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def components_strong(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components with more than one node or a loop.

    component is its smallest node.  The rounds of strong_sets run over numbers of the names.
    """
    links = materialize(edges.select("src", "dst").distinct())
    names = materialize(nodes_of(links.filter("src <> dst")).orderBy("node").select(F.monotonically_increasing_id().alias("id"), "node"))
    number = lambda end: shuffled(names.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id")))
    e = materialize(links.filter("src <> dst").join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    sets = strong_sets(e)
    release(e)
    return by_smallest(sets.withColumnRenamed("node", "id").join(shuffled(names), "id").select("node", "root"), links.filter("src = dst").select(F.col("src").alias("node")))


def by_smallest(sets: DataFrame, loops: DataFrame) -> DataFrame:
    """(node, component) of the (node, root) of sets and of the nodes with loops: component is the smallest node."""
    strong = sets.join(sets.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
    alone = loops.join(strong, "node", "left_anti").select("node", F.col("node").alias("component"))
    return strong.unionByName(alone)


def _carried(links: DataFrame, state: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, c, was): the greatest c that reaches each node of (node, c) along links, or does so in some rounds.

    Only nodes whose c is new (was, the one a step before, differs) offer it.
    """
    state = state.withColumn("was", F.lit(None).cast("long"))
    while rounds is None or rounds:
        new = state
        for _ in range(4):  # steps a round
            offers = links.join(new.filter("NOT (c <=> was)"), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c", F.lit(None).cast("long").alias("was"))
            new = new.select("node", "c", F.col("c").alias("was")).unionByName(offers).groupBy("node").agg(F.max("c").alias("c"), F.max("was").alias("was"))
        last, state = state, materialize(new)
        release(last)
        if state.filter("NOT (c <=> was)").isEmpty():
            break
        rounds = rounds and rounds - 1
    return state


def _strong_once(e: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root): for the colours of one pass, the root and what it reaches that reaches it.

    The greatest number that reaches a node colours it; what reaches a colour's own node within the
    colour is strong with it.  That holds as well after some rounds, only that sets may lack nodes.
    """
    colour = _carried(e, nodes_of(e).withColumn("c", F.col("node")), rounds)
    of = colour.select("node", "c")
    inside = materialize(e.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst"))
    back = _carried(reverse(inside), of.withColumn("c", F.when(F.col("node") == F.col("c"), F.col("c"))), rounds)
    release(colour)
    release(inside)
    return back.filter("c IS NOT NULL").select("node", F.col("c").alias("root"))


def strong_sets(e: DataFrame) -> DataFrame:
    """(node, root) of the strongly connected sets of two nodes and more; e: (src, dst) numbers, no pair twice, no loops.

    What is strong over few edges, two ahead and two back a node, is one node for all others, so
    that most edges are read four times only.  Then come rounds over all edges that are left: nodes
    that cannot lie on a cycle are trimmed, and one pass of colours finds a set for each root.
    The files of rounds gone by are deleted.
    """
    e = e.filter("src IS NOT NULL AND dst IS NOT NULL")
    two = lambda a, b: e.groupBy(a).agg(F.array(F.min(b), F.max(b)).alias(b)).select(a, F.explode(b).alias(b))
    few = materialize(two("src", "dst").unionByName(two("dst", "src")).distinct())
    near = None
    if few.count() * 2 < e.count():
        near = materialize(_strong_once(few, 3).filter("node <> root"))
        to = lambda end: near.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        whole = e.join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"))
        e = materialize(whole.filter("src <> dst").distinct())
    release(few)
    found = []
    while True:
        before = e.count()
        while before:  # trim
            trimmed = e
            for _ in range(3):  # steps a round
                trimmed = trimmed.join(trimmed.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(trimmed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            last, e = e, materialize(trimmed)
            after = e.count()
            release(last)
            if before == after:
                break
            before = after
        if not before:
            break
        mine = _strong_once(e)
        found.append(mine.filter("node <> root"))
        done = mine.select("node")
        last, e = e, materialize(e.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        release(last)
    none = e.select(F.col("src").alias("node"), F.col("dst").alias("root")).limit(0)
    far = materialize(reduce(DataFrame.unionByName, found, none))
    sets = far
    if near is not None:
        outer = far.select(F.col("node").alias("root"), F.col("root").alias("r"))
        sets = far.unionByName(near.join(outer, "root", "left").select("node", F.coalesce("r", "root").alias("root")))
    return materialize(sets.unionByName(sets.select(F.col("root").alias("node"), "root").distinct()))


def cycles(components: DataFrame) -> DataFrame:
    """(component, size), the largest first."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, start, length): the shortest cycle of each component, and the first node on one of that length.

    A self loop has length 1.  All nodes are starts, and all walk together: ahead and back from a
    start, through nodes after it only, for the first node on a shortest cycle is the start of that
    cycle.  Where the two ways of a start meet, a cycle closes; the side with fewer walks goes on
    by one step a round.  A start ends when one of its sides does, a component with its first cycle.
    """
    c = components.select("node", "component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().join(c, "node")
    found, length = [materialize(loops.groupBy("component").agg(F.min("node").alias("start")).withColumn("length", F.lit(1)))], 2
    c = materialize(c.join(found[0].select("component"), "component", "left_anti").select("node", "component"))
    e = edges.filter("src <> dst").select("src", "dst").distinct().join(c.toDF("src", "component"), "src").join(c.toDF("dst", "b"), "dst").filter("component = b").select("component", "src", "dst")
    e = materialize(e)
    turned = e.select("component", F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = [(x, [materialize(x.filter("dst > src").select("component", F.col("src").alias("start"), F.col("dst").alias("node")))]) for x in (e, turned)]
    ends = [seen[0] for _, seen in ways]  # ahead and back
    while not any(x.isEmpty() for x in ends):
        closing = materialize(ends[0].join(ends[1].select("start", "node"), ["start", "node"], "left_semi").groupBy("component").agg(F.min("start").alias("start")).withColumn("length", F.lit(length)))
        found.append(closing)
        side = int(ends[1].count() < ends[0].count())
        links, seen = ways[side]
        going = ends[side].join(closing.select("component"), "component", "left_anti").join(ends[1 - side].select("start").distinct(), "start", "left_semi")
        step = going.join(links.select("src", "dst"), F.col("node") == F.col("src")).filter("dst > start").select("component", "start", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, seen).select("start", "node")
        ends[side] = materialize(step.join(known, ["start", "node"], "left_anti"))
        ends[1 - side] = materialize(ends[1 - side].join(ends[side].select("start").distinct(), "start", "left_semi"))
        seen.append(ends[side])
        length += 1
        for parts in (seen, found):  # keep plans and file lists short on long rings
            if len(parts) > 8:
                parts[:] = [materialize(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, found).select("component", "start", "length")


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing imports."""
    return nodes.join(edges.filter("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node")


def capabilities(edges: DataFrame) -> DataFrame:
    """(extension, edges, deferred) by the source's extension."""
    return edges.groupBy(extension(F.col("src")).alias("extension")).agg(F.count(F.lit(1)).alias("edges"), F.count_if("deferred").alias("deferred"))


def patched(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after a change: those from changed files go, the fresh ones come."""
    return edges.join(changed.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select(*edges.columns).unionByName(fresh.select(*edges.columns)).distinct()


def leaks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from production code to tests or fixtures; nodes: (node, role)."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("role").alias("src_role")), nodes.select(F.col("node").alias("dst"), F.col("role").alias("dst_role"))
    return edges.join(a, "src").join(b, "dst").filter("src_role = 'production' AND dst_role IN ('test', 'fixture')").select("src", "dst")


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, dst, src_layer, dst_layer): imports from a layer into one above it.

    layers: (layer, pattern); a file's layer is the first whose pattern matches its path.
    """

    from .patterns import first_match

    of = materialize(nodes_of(edges).withColumn("layer", first_match(F.col("node"), layers, "layer", "pattern")))
    j = edges.select("src", "dst").distinct().join(of.toDF("src", "src_layer"), "src").join(of.toDF("dst", "dst_layer"), "dst")
    return j.filter("dst_layer < src_layer").select("src", "dst", "src_layer", "dst_layer")


def package_of(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """(node, package): the longest root that holds the node; packages: (package, root).

    Prefixes of a path are few, so they are joined by equality instead of by comparison.
    """
    p = F.split("node", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    each = nodes.select("node", F.explode(F.array_union(ups, F.array(F.lit("")))).alias("root"))
    return each.join(packages, "root").groupBy("node").agg(F.max_by("package", F.length("root")).alias("package"))


def boundary_violations(edges: DataFrame, membership: DataFrame, public: DataFrame) -> DataFrame:
    """Imports across packages of files that are no public API; public: (node)."""
    m = membership
    j = edges.select("src", "dst").distinct().join(m.toDF("src", "src_package"), "src").join(m.toDF("dst", "dst_package"), "dst").filter("src_package <> dst_package")
    return j.join(public.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst", "src_package", "dst_package")


# ---- rules, summaries and snapshots ---------------------------------------------------------

#: Default limits of fan-out and of lists in summaries.
MAX_FAN_OUT, TOP_FILES, TOP_CYCLES, CYCLE_DEPTH = 15, 10, 10, 512


def excessive_fan_out(d: DataFrame, facades: DataFrame | None = None, most: int = MAX_FAN_OUT) -> DataFrame:
    """(node, fan_out) of files that import more than `most` others; facades (node) are exempt."""
    rows = d.filter(F.col("fan_out") > most)
    return (rows if facades is None else rows.join(facades.select("node"), "node", "left_anti")).select("node", "fan_out")


def rust_facades(files: DataFrame) -> DataFrame:
    """(node): lib.rs and mod.rs whose lines only declare or re-export modules."""
    line = F.trim(F.translate("line", "\t\r", "  "))
    plain = F.regexp_replace(F.regexp_replace(line, r";$", ""), r"^pub(\((crate|super)\))? ", "")
    declares = F.startswith(plain, F.lit("mod ")) | F.startswith(plain, F.lit("use ")) | F.startswith(plain, F.lit("extern crate "))
    skip = (line == "") | F.startswith(line, F.lit("//")) | F.startswith(line, F.lit("#["))
    each = files.filter(F.col("path").rlike(r"(^|/)(lib|mod)\.rs$")).select("path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line"))
    judged = each.groupBy("path").agg(F.count_if(~skip & declares).alias("yes"), F.count_if(~skip & ~declares).alias("no"))
    return judged.filter("yes > 0 AND no = 0").select(F.col("path").alias("node"))


#: Files that are reached by name, by a loader or by a router, not by an import.
LOADED_PY = ("conftest.py", "wagtail_hooks.py", "apps.py", "admin.py", "urls.py", "wsgi.py", "asgi.py", "__init__.py")
ROUTED = ("page", "layout", "_layout", "route", "template", "loading", "error", "not-found", "+not-found", "+html", "_app", "_document")
VENDORED, EXAMPLE_TREES = ("vendor", "vendors", "node_modules", "third_party"), ("docs_src", "doc_src", "docs-src", "examples", "samples")


def reached_without_import(path: Column, executable: Column | None = None) -> Column:
    """Whether a file is used without anything importing it: by a tool, build, framework, router or browser."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    within = lambda *names: has_component(low, names)
    stem = F.regexp_extract(name, r"^(.*)\.(?:mts|cts|mjs|cjs|tsx|jsx|ts|js|kts)$", 1)  # of scripts only
    script = stem != ""
    python = F.endswith(name, F.lit(".py"))
    example = F.arrays_overlap(F.slice(F.split(low, "/"), 1, 3), F.array(*map(F.lit, EXAMPLE_TREES)))
    browser = within("entrypoints", "static_src", "static") | (script & stem.rlike(r"(^|[.-])(worker|sw)([.-]|$)"))
    binary = within("bin") | stem.isin("bin", "cli")
    build = name.rlike(r"\.gradle(\.kts)?$") | stem.isin("gulpfile", "gruntfile")
    tool = script & (stem.rlike(r"\.(config|conf)$") | stem.rlike(r"^\..*rc$"))
    autoload = (script & stem.rlike(r"\.(stories|story)$")) | (python & (low.rlike(r"(^|/)management/commands/") | within("migrations", "templatetags") | name.isin(*LOADED_PY)))
    routed = stem.isin(*ROUTED) & within("app", "pages")
    out = name.rlike(r"\.d\.[mc]?ts$") | within(*VENDORED) | example | browser | binary | build | tool | autoload | routed | within("scripts")
    return out if executable is None else out | (executable & within("commands"))


#: Languages, by ending, whose imports name files, so that nothing importing one means something.
ABSENCE_ENDINGS = ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go")


def dead_modules(files: DataFrame, d: DataFrame, unresolved: DataFrame, resolved_edges: DataFrame) -> DataFrame:
    """(path, confidence): production files that nothing imports and nothing else reaches.

    files: (path, role, entrypoint, public, has_inline_tests).  unresolved: (ext, spec) of local
    imports that mean no file; resolved_edges: (ext, edges).  A file is skipped if an unresolved
    import might mean it, or if its language has more unresolved imports than edges; with any
    unresolved import left, confidence is LOW.
    """
    n = unresolved.agg(F.count(F.lit(1)).alias("_unresolved"))
    stems = unresolved.select(F.explode(import_stems(F.col("spec"))).alias("_stem")).select(F.lower("_stem").alias("_stem")).distinct()
    by_ext = unresolved.groupBy("ext").agg(F.count(F.lit(1)).alias("_u")).join(resolved_edges, "ext", "left").filter("_u > coalesce(edges, 0)").select(F.col("ext").alias("_unmapped"))
    p = F.col("path")
    ext = extension(p)
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]*$", "")
    rows = files.join(d.filter("fan_in > 0").select(F.col("node").alias("path")), "path", "left_anti")
    rows = rows.filter((F.col("role") == "production") & ~F.col("entrypoint") & ~F.col("public") & ~F.col("has_inline_tests") & ext.isin(*ABSENCE_ENDINGS) & ~reached_without_import(p))
    rows = rows.join(stems, F.lower(stem) == F.col("_stem"), "left_anti").join(by_ext, ext == F.col("_unmapped"), "left_anti")
    return rows.crossJoin(n).select("path", F.when(F.col("_unresolved") > 0, "LOW").otherwise("HIGH").alias("confidence"))  # n is one row


def import_stems(spec: Column) -> Column:
    """File stems that an import may mean: its last segment's first and last dotted parts."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(spec), "/+$", ""), r"[/\\]"), -1)
    parts = F.split(last, r"\.")
    return F.filter(F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1))), lambda s: s != "")


def readiness(claim: Column, file_nodes: Column, unresolved: Column, target_unresolved: Column, ext_unresolved: Column, ext_edges: Column) -> Column:
    """What the graph can answer: available, limited, or why it is unavailable.

    Claims: presence, absence, target-absence.  Presence always holds; an absence is only as good
    as the resolved part of the graph.
    """
    target = claim == "target-absence"
    return (
        F.when(claim == "presence", "available").when(file_nodes == 0, "no-file-graph").when(target & target_unresolved, "unresolved-target")
        .when(target & (ext_unresolved > 0) & (ext_edges < ext_unresolved), "language-unmapped").when(unresolved > 0, "limited").otherwise("available")
    )


def hubs(d: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """(kind, node, fan_in, fan_out, truncated): the top hubs by fan-out and dependencies by fan-in.

    One row more than asked for tells whether the list was cut; both lists have k + 1 rows at most.
    """

    def top(kind, df):
        numbered = df.limit(k + 1).withColumn("kind", F.lit(kind))
        first, other = ("fan_out", "fan_in") if kind == "hub" else ("fan_in", "fan_out")
        w = Window.partitionBy("kind").orderBy(F.desc(first), F.desc(other), "node")
        all_ = Window.partitionBy("kind")
        return numbered.withColumns({"n": F.row_number().over(w), "truncated": F.count(F.lit(1)).over(all_) > k}).filter(F.col("n") <= k).select("kind", "node", "fan_in", "fan_out", "truncated")

    return top("hub", top_fan_out(d, k + 1)).unionByName(top("dependency", top_fan_in(d, k + 1)))


def bounded_cycles(edges: DataFrame, most: int = TOP_CYCLES, depth: int = CYCLE_DEPTH) -> DataFrame:
    """(cycle, truncated): the first `most` cycles that walks of the components meet, each from its smallest node.

    Components are walked apart, in one job; see cyclerules.cycles_met.
    """
    from .cyclerules import cycles_met

    found = materialize(cycles_met(edges, materialize(components_strong(edges)), most, depth).select("cycle"))
    return found.orderBy("cycle").limit(most).withColumn("truncated", F.lit(found.count() > most))


def contained(edges: DataFrame) -> DataFrame:
    """edges without those from a Rust module file to the files of its own module directory."""
    name = F.regexp_replace(F.element_at(F.split("src", "/"), -1), r"\.rs$", "")
    dir_ = parent(F.col("src"))
    own = F.when(name.isin("mod", "lib", "main"), dir_).otherwise(F.concat_ws("/", F.when(dir_ != "", dir_), name))
    rust = F.endswith("src", F.lit(".rs")) & F.endswith("dst", F.lit(".rs"))
    base = F.element_at(F.split("dst", "/"), -1)
    up = parent(F.col("dst"))
    inner = ((up == own) & (base != F.element_at(F.split("src", "/"), -1))) | ((base == "mod.rs") & (parent(up) == own) & (up != ""))
    return edges.filter(~(rust & inner))


def snapshot(files: DataFrame, imports: DataFrame, packages: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (src, dst, kind, confidence) of a repository.

    imports: (src, spec, dst), dst null where no file is meant: relative ones are gaps of low
    confidence, others depend on something external.  packages: (path, package).  tests: (src, dst).
    """
    local = imports.filter("dst IS NOT NULL AND dst <> src")
    other = imports.filter("dst IS NULL AND trim(spec) <> ''").withColumn("spec", F.trim("spec"))
    file_id, ext_id = lambda c: F.concat(F.lit("file:"), c), lambda c: F.concat(F.lit("external:"), c)
    edge = lambda df, a, b, kind, conf: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), conf.alias("confidence"))
    edges = edge(local, file_id(F.col("src")), file_id(F.col("dst")), "imports", F.lit("HIGH"))
    edges = edges.unionByName(edge(other, file_id(F.col("src")), ext_id(F.col("spec")), "depends-on", F.when(F.startswith("spec", F.lit(".")), "LOW").otherwise("MEDIUM")))
    edges = edges.unionByName(edge(tests, file_id(F.col("src")), file_id(F.col("dst")), "test-of", F.lit("HIGH")))
    nodes = files.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("label"))
    nodes = nodes.unionByName(other.select(ext_id(F.col("spec")).alias("id"), F.lit("external").alias("kind"), F.col("spec").alias("label")).distinct())
    nodes = nodes.unionByName(packages.select(F.concat(F.lit("package:"), "package").alias("id"), F.lit("package").alias("kind"), F.col("package").alias("label")).distinct())
    return nodes.distinct(), edges.groupBy("src", "dst", "kind").agg(F.max_by("confidence", F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)).alias("confidence"))


def snapshot_capabilities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: file and external nodes, and dependency edges by confidence."""
    n = nodes.agg(F.count_if(F.col("kind") == "file").alias("file_nodes"), F.count_if(F.col("kind") == "external").alias("external_nodes"))
    of = lambda c: F.count_if(F.col("confidence") == c)
    e = edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).agg(of("HIGH").alias("resolved_edges"), of("MEDIUM").alias("external_edges"), of("LOW").alias("unresolved_edges"))
    return n.crossJoin(e)  # one row each


def coupling_snapshot(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot of a plain import graph: files only, all edges of high confidence."""
    e = edges.select("src", "dst").distinct()
    nodes = nodes_of(e).select(F.concat(F.lit("file:"), "node").alias("id"), F.lit("file").alias("kind"), F.col("node").alias("label"))
    return nodes, e.select(F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.lit("file:"), "dst").alias("dst"), F.lit("imports").alias("kind"), F.lit("HIGH").alias("confidence"))


def context_summary(edges: DataFrame, changed: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """(section, item, n, truncated): files, edges, top hubs and dependencies, and what depends on changed files."""
    d = degrees(nodes_of(edges), edges)
    row = lambda df, section, item, n, cut: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"), cut.alias("truncated"))
    no = F.lit(False)
    totals = d.agg(F.count(F.lit(1)).alias("f")).crossJoin(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("e")))  # one row each
    out = row(totals, "files", F.lit("files"), F.col("f"), no).unionByName(row(totals, "import-edges", F.lit("edges"), F.col("e"), no))
    h = hubs(d, k)
    out = out.unionByName(row(h.filter("kind = 'hub'"), "hub", F.col("node"), F.col("fan_out"), F.col("truncated"))).unionByName(row(h.filter("kind = 'dependency'"), "dependency", F.col("node"), F.col("fan_in"), F.col("truncated")))
    near = dependent_counts(edges).join(changed.select("node").distinct(), "node", "left_semi")
    return out.unionByName(row(near, "changed-blast-radius", F.col("node"), F.col("dependents"), no))
