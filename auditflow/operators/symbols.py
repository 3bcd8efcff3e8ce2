"""What files export in the end: their own symbols, and those of others that they export again.

`export * from`, `export {a as b} from`, `from .x import a` and `pub use` hand a symbol on, from
file to file.  The closure grows from the files that define symbols, one hand a round, until
nothing is new; a symbol that a file defines or names outranks one that comes with a star, and a
ring of re-exports ends, since a file's symbol is settled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.storage import dealt, materialize, shuffled
from .exports import exported

_SCRIPT = ("JavaScript", "TypeScript")
_AGAIN = r"""(?m)^\s*export\s+(?:type\s+)?(?:\{[^}]*\}|\*(?:\s*as\s+[\w$]+)?)\s*from\s*['"][^'"]+['"]"""
_FROM = r"(?m)^from[ \t]+\.[\w.]*[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#]+)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def own(files: DataFrame) -> DataFrame:
    """(path, symbol) that files (path, language, content) define and export themselves."""
    text = F.coalesce("content", F.lit(""))
    alone = F.regexp_replace(text, _AGAIN, "")
    defined = F.filter(F.concat(F.regexp_extract_all(text, F.lit(r"(?m)^(?:async[ \t]+)?(?:def|class)[ \t]+(\w+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_]\w*)[ \t]*(?::[^=\n]+)?=(?!=)"), F.lit(1))), lambda s: ~s.startswith("_"))
    found = F.when(F.col("language") == "Python", F.array_distinct(defined)).otherwise(exported(alone, F.col("language")))
    return files.select("path", F.explode(found).alias("symbol"))


def _names(listed: Column) -> Column:
    """(name, as) of a list of names, each maybe with another one."""
    bare = F.regexp_replace(listed, r"[(){}\n\\]", " ")
    each = F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^type\s+", "")), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"^([\w$*]+)", 1).alias("target"), F.regexp_extract(x, r"([\w$*]+)$", 1).alias("symbol")))


def again(files: DataFrame) -> DataFrame:
    """(path, symbol, spec, target): what files export of others; a star's symbol and target are *."""
    text = F.coalesce("content", F.lit(""))
    js = files.filter(F.col("language").isin(*_SCRIPT)).select("path", F.explode(_all(text, _AGAIN)).alias("x"))
    star = F.regexp_extract("x", r"\*\s*as\s+([\w$]+)", 1)
    listed = F.when(F.col("x").contains("{"), _names(F.regexp_extract("x", r"\{([^}]*)\}", 1))).otherwise(F.array(F.struct(F.lit("*").alias("target"), F.when(star != "", star).otherwise("*").alias("symbol"))))
    js = js.select("path", F.regexp_extract("x", r"""from\s*['"]([^'"]+)['"]""", 1).alias("spec"), F.explode(listed).alias("n"))
    py = files.filter((F.col("language") == "Python") & F.col("path").rlike(r"(^|/)__init__\.py$")).select("path", F.explode(_all(text, _FROM)).alias("x"))
    py = py.select("path", F.regexp_extract("x", r"^from[ \t]+(\.[\w.]*)", 1).alias("spec"), F.explode(_names(F.regexp_replace("x", r"^from[ \t]+\.[\w.]*[ \t]+import[ \t]+", ""))).alias("n"))
    return js.unionByName(py).select("path", "n.symbol", "spec", "n.target")


def placed(handed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, symbol, dst, target): again() with the files meant, from resolved imports (src, spec, dst)."""
    r = resolved.filter("dst IS NOT NULL").select(F.col("src").alias("path"), "spec", "dst").distinct()
    return handed.join(shuffled(r), ["path", "spec"]).select("path", "symbol", "dst", "target")


def closure(own_: DataFrame, handed: DataFrame) -> DataFrame:
    """(path, symbol, origin, origin_symbol): every symbol that can be imported from a file, and where it is defined."""
    handed = materialize(handed)  # read twice below; it holds the search for what imports mean
    named = handed.filter("symbol <> '*' AND target <> '*'")
    stars = materialize(handed.filter("symbol = '*'").select("path", "dst").distinct())
    explicit = own_.select("path", "symbol").unionByName(named.select("path", "symbol")).distinct()
    explicit = materialize(explicit)
    new = materialize(own_.select("path", "symbol", F.col("path").alias("origin"), F.col("symbol").alias("origin_symbol")).distinct())
    done = [new]
    while True:
        known = done[0]
        for more in done[1:]:
            known = known.unionByName(more)
        at = shuffled(new.select(F.col("path").alias("dst"), F.col("symbol").alias("target"), "origin", "origin_symbol"))
        by_name = named.join(at, ["dst", "target"]).select("path", "symbol", "origin", "origin_symbol")
        by_star = stars.join(at.filter("target <> 'default'"), "dst").select("path", F.col("target").alias("symbol"), "origin", "origin_symbol").join(shuffled(explicit), ["path", "symbol"], "left_anti")
        step = by_name.unionByName(by_star).join(shuffled(known.select("path", "symbol")), ["path", "symbol"], "left_anti")
        new = materialize(step.groupBy("path", "symbol").agg(F.min(F.struct("origin", "origin_symbol")).alias("o")).select("path", "symbol", "o.origin", "o.origin_symbol"))
        if new.isEmpty():
            return known
        done.append(new)
        if len(done) > 8:
            whole = done[0]
            for more in done[1:]:
                whole = whole.unionByName(more)
            done = [materialize(whole)]


def of_files(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """The closure of files, whose imports are resolved (src, spec, dst)."""
    files = dealt(files, "path")
    return closure(materialize(own(files)), placed(again(files), resolved))


def lost(before: DataFrame, after: DataFrame, used: DataFrame) -> DataFrame:
    """(importer, dst, symbol, origin): imports (importer, dst, symbol) that found their symbol before and no longer do."""
    gone = before.join(shuffled(after.select("path", "symbol")), ["path", "symbol"], "left_anti")
    return used.select("importer", "dst", "symbol").distinct().join(shuffled(gone.select(F.col("path").alias("dst"), "symbol", "origin")), ["dst", "symbol"]).select("importer", "dst", "symbol", "origin")
