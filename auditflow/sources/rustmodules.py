"""Rust's module tree, and the files that paths in `use` mean.

Files are modules because others declare them: `mod x;` names a file by its place or by `#[path]`,
and files that nobody declares are the roots of crates.  The tree grows from the roots, a level a
round, until no declaration leads to a new file.  A path in a `use` begins at the crate, at its own
module, above it, or at a child; the longest part of it that is a module of the tree is what it
means, or, where the tree has none, the longest part that is a file by its place.  Items behind
`#[cfg(test)]` and `#[test]` count for nothing.  `include!` means the file that it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import parent
from ..operators.treerules import test_only
from ..plans.storage import materialize

KINDS = ("use", "mod", "macro", "type")


def _inside() -> Column:
    """Names of the modules inside its file that a node stands in."""
    return F.transform(F.filter("around", lambda a: (a["kind"] == "type") & (a["word"] == "mod")), lambda a: F.regexp_extract(a["name"], r"^\w+", 0))


def _own_dir(path: Column) -> Column:
    """Where the files of a file's child modules lie by their names."""
    stem = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    return F.when(stem.isin("lib", "main", "mod"), parent(path)).otherwise(F.regexp_replace(path, r"\.rs$", ""))


def _joined(folder: Column, *names: Column) -> Column:
    """A path below a folder, with its dots resolved; the folder may be empty."""
    text = F.concat_ws("/", F.when(folder != "", folder), *names)
    return F.array_join(F.aggregate(F.split(text, "/"), F.array().cast("array<string>"), lambda out, x: F.when(x.isin("", "."), out).when((x == "..") & (F.size(out) > 0), F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.array_append(out, x))), "/")


def declarations(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, names, dst): files that files declare as modules; names: from the file's own module on."""
    mods = nodes.filter((F.col("kind") == "mod") & ~test_only())
    inside, explicit = _inside(), F.regexp_extract("marks", r'#\[path\s*=\s*"([^"]*)"\]', 1)
    folder = F.when(F.size(inside) > 0, F.concat_ws("/", F.when(_own_dir(F.col("path")) != "", _own_dir(F.col("path"))), F.array_join(inside, "/"))).otherwise(_own_dir(F.col("path")))
    here = F.when(F.size(inside) > 0, folder).otherwise(parent(F.col("path")))
    by_name = F.array(_joined(folder, F.concat("name", F.lit(".rs"))), _joined(folder, F.col("name"), F.lit("mod.rs")))
    candidates = F.when(explicit != "", F.array(_joined(here, explicit))).otherwise(by_name)
    each = mods.select(F.col("path").alias("src"), F.array_append(inside, F.col("name")).alias("names"), "first", F.posexplode(candidates).alias("i", "dst"))
    return each.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "names").agg(F.min_by("dst", "i").alias("dst"))


def module_tree(declared: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(root, names, path): modules by the names that lead to them from the root of their crate.

    A file that is declared twice is a module twice; modules inside a file stand beside it.
    """
    roots = files.select("path").join(declared.select(F.col("dst").alias("path")), "path", "left_anti")
    new = materialize(roots.select(F.col("path").alias("root"), F.array().cast("array<string>").alias("names"), "path"))
    tree = new
    while True:
        # a chain of declarations that comes back to a file it has passed is cut there
        grown = new.join(declared.withColumnRenamed("names", "more"), new.path == declared.src).select("root", F.concat("names", "more").alias("names"), F.col("dst").alias("path"), F.col("src").alias("via"))
        new = materialize(grown.join(tree.select("root", "path").distinct(), ["root", "path"], "left_anti").select("root", "names", "path").distinct())
        if new.isEmpty():
            break
        tree = materialize(tree.unionByName(new))
    inner = nodes.filter((F.col("kind") == "type") & (F.col("word") == "mod") & ~test_only()).select("path", F.array_append(_inside(), F.regexp_extract("name", r"^\w+", 0)).alias("more"))
    return tree.unionByName(tree.join(inner, "path").select("root", F.concat("names", "more").alias("names"), "path")).distinct()


def uses(nodes: DataFrame) -> DataFrame:
    """(src, inside, spec, name, public) of each path that a file uses, and what includes name."""
    return nodes.filter((F.col("kind") == "use") & ~test_only()).select(F.col("path").alias("src"), _inside().alias("inside"), F.split("name", " as ")[0].alias("spec"), F.split("name", " as ")[1].alias("name"), (F.col("word") == "pub").alias("public"))


def targets(used: DataFrame, tree: DataFrame) -> DataFrame:
    """used with root, target and rest: the module's file that a path means, and what of the path comes after.

    target is null for what is no module here: other crates, and items of the crate's root.
    """
    own = tree.select(F.col("root"), F.col("names").alias("base"), F.col("path").alias("src"))
    first = tree.groupBy("path", "root").agg(F.min("names").alias("base")).withColumnRenamed("path", "src")  # a file's own module is the shortest
    placed = used.join(first, "src").withColumn("id", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("spec", "^::", ""), "::")
    here = F.concat("base", "inside")
    ups = F.size(F.filter(parts, lambda x: x == "super"))
    plain = F.filter(parts, lambda x: ~x.isin("crate", "self", "super", "*"))
    start = F.when(parts[0] == "crate", F.array().cast("array<string>")).when(parts[0] == "super", F.slice(here, F.lit(1), F.greatest(F.size(here) - ups, F.lit(0)))).otherwise(here)
    absolute = F.concat(start, plain)
    local = ~parts[0].isin("crate", "self", "super")
    placed = materialize(placed.withColumns({"absolute": absolute, "least": F.when(local, F.size(start) + 1).otherwise(1)}))
    cut = placed.select("id", "root", "absolute", "least", F.explode(F.expr("filter(sequence(0, size(absolute)), x -> x >= least)")).alias("n")).withColumn("names", F.slice("absolute", F.lit(1), F.col("n")))
    hit = cut.join(tree.select("root", "names", F.col("path").alias("target")), ["root", "names"]).groupBy("id").agg(F.max_by("target", "n").alias("target"), F.max("n").alias("n"))
    out = placed.join(hit, "id", "left")
    rest = F.when(F.col("n").isNotNull(), F.slice("absolute", F.col("n") + 1, F.size("absolute"))).otherwise(F.col("absolute"))
    return out.withColumn("rest", rest).select("src", "inside", "spec", "name", "public", "root", "target", "rest", "base")


def _by_place(missed: DataFrame, files: DataFrame) -> DataFrame:
    """(src, spec, dst) of paths that no declared module answers: the longest part that is a file by its place."""
    parts = F.split("spec", "::")
    folder = _own_dir(F.col("src"))
    ups = F.size(F.filter(parts, lambda x: x == "super"))
    crate = F.when(F.col("src").contains("/src/"), F.concat(F.regexp_extract("src", r"^(.*?)/src/", 1), F.lit("/src"))).otherwise("src")
    up = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - ups, F.lit(0))), "/")
    top = F.when(parts[0] == "crate", crate).when(parts[0] == "super", up).when(parts[0] == "self", folder)
    plain = F.filter(parts, lambda x: ~x.isin("crate", "self", "super", "*"))
    each = missed.select("src", "spec", top.alias("top"), plain.alias("p")).filter("top IS NOT NULL AND size(p) > 0").distinct().select("src", "spec", "top", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    base = F.slice("p", F.lit(1), F.col("n"))
    both = each.select("src", "spec", "n", F.posexplode(F.array(_joined(F.col("top"), F.concat(F.array_join(base, "/"), F.lit(".rs"))), _joined(F.col("top"), F.array_join(base, "/"), F.lit("mod.rs")))).alias("i", "dst"))
    return both.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "spec").agg(F.max_by("dst", F.col("n") * 2 - F.col("i")).alias("dst"))


def edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) once each: files that Rust files declare, use or include.

    nodes: of KINDS, written; files: (path) of all Rust files.
    """
    declared = materialize(declarations(nodes, files))
    met = materialize(targets(uses(nodes), module_tree(declared, nodes, files)))
    included = nodes.filter((F.col("kind") == "macro") & (F.col("name") == "include") & ~test_only()).select(F.col("path").alias("src"), _joined(parent(F.col("path")), F.col("word")).alias("dst")).join(files.select(F.col("path").alias("dst")), "dst")
    missed = met.filter("target IS NULL").join(met.filter("target IS NOT NULL").select("src", "spec"), ["src", "spec"], "left_anti")
    used = met.filter("target IS NOT NULL").select("src", F.col("target").alias("dst"))
    every = declared.select("src", "dst").unionByName(used).unionByName(included.select("src", "dst")).unionByName(_by_place(missed, files).select("src", "dst"))
    return every.filter("src <> dst").distinct()
