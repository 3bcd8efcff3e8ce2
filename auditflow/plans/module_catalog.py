"""Queries on modules: imports of several languages, Rust's module tree, re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators import cyclerules, graph, patternindex, symbols
from ..sources import imports, rustmodules, syntax
from .catalog import _register
from .storage import materialize, table


def _pick(values, number: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), number.cast("int"))


#: A crate's files: place below it, text, and the places that it means.
CRATE = (
    ("src/lib.rs", "#![allow(x)]\nmod m1;\npub(crate) mod m2;\n#[path = \"odd/place.rs\"]\nmod m7;\n/* mod m9; */\nmod m3; mod m4;\n#[cfg(test)]\nmod m6;\nmod m5;\n", ("src/m1.rs", "src/m2/mod.rs", "src/odd/place.rs", "src/m3.rs", "src/m4.rs", "src/m5.rs")),
    ("src/m1.rs", "use crate::{m2::{self, A as B}, m7::Thing};\nuse std::{fmt, io::{self, Read}};\n", ("src/m2/mod.rs", "src/odd/place.rs")),
    ("src/m2/mod.rs", "use super::m3::x;\n#[cfg(test)]\nuse crate::m4::T;\n#[cfg(all(test, unix))]\nmod other {}\n#[cfg(test)]\nmod tests {\n    use crate::m5::S;\n    fn f() { include!(\"../m1.rs\"); }\n}\n", ("src/m3.rs",)),
    ("src/m3.rs", "mod inner;\npub use inner::{Y, *};\n", ("src/m3/inner.rs",)),
    ("src/m4.rs", "// use crate::m1;\nconst S: &str = r#\"use crate::m1;\"#;\nuse crate::missing::X;\nuse serde::m1;\n", ()),
    ("src/m5.rs", "include!(\"m4.rs\");\nconst D: &str = include_str!(\"m3.rs\");\npub use self::deep::Z;\nmod deep {\n    pub use crate::m1::Q;\n    use super::super::m2::*;\n}\n", ("src/m4.rs", "src/m1.rs", "src/m2/mod.rs")),
    ("src/m3/inner.rs", "use super::super::m4::{Y as W,};\nuse super::inner2;\n", ("src/m4.rs", "src/m3.rs")),
    ("src/odd/place.rs", "use super::m1::A;\nuse crate::m3::inner::Y;\n", ("src/m1.rs", "src/m3/inner.rs")),
)
_PLACES = ", ".join(f"({i}, '{p}')" for i, (p, *_) in enumerate(CRATE))
_MEANT = ", ".join(f"('{p}', '{d}')" for p, _, means in CRATE for d in means)


def crates(spark, sf_dir) -> DataFrame:
    """(path, language, content): a crate for every eight parts."""
    k = F.col("p_partkey")
    no = k % len(CRATE)
    top = F.concat(F.lit("c"), F.floor(k / len(CRATE)), F.lit("/"))
    return table(spark, sf_dir, "part").select(F.concat(top, _pick([c[0] for c in CRATE], no)).alias("path"), F.lit("Rust").alias("language"), _pick([c[1] for c in CRATE], no).alias("content"))


_CRATES = f"places(no, place) AS (VALUES {_PLACES}), meant(place, target) AS (VALUES {_MEANT}), placed AS (SELECT concat('c', p_partkey // {len(CRATE)}, '/') AS top, place FROM part JOIN places ON p_partkey % {len(CRATE)} = no)"


@_register("SELECT concat(a.top, a.place) AS src, concat(b.top, b.place) AS dst FROM placed a JOIN meant USING (place) JOIN placed b ON a.top = b.top AND b.place = target", also=_CRATES)
def rust_module_edges(spark, sf_dir):
    f = crates(spark, sf_dir)
    n = materialize(syntax.nodes(f, rustmodules.KINDS))
    return rustmodules.edges(n, f.select("path"))


#: Packages of other languages: ending language, place, text ({g}: the package's number), and the places meant (deferred ones marked ~).
PACKAGES = (
    ("Python", "__init__.py", "from .b import run\n", ("b.py",)),
    ("Python", "a.py", "import p{g}.c as c\nfrom . import d\nfrom .b import (\n    run,\n    walk,\n)\nimport os, sys\n", ("c.py", "d.py", "b.py")),
    ("Python", "b.py", "def run():\n    from . import a\n    import p{g}.c\n\ntext = 'import p{g}.d'\n# import p{g}.d\n", ("~a.py", "~c.py")),
    ("Python", "c.py", "try:\n    import p{g}.d\nexcept ImportError:\n    pass\n", ("d.py",)),
    ("Python", "d.py", "x = 1\n", ()),
    ("Java", "src/main/java/org/A.java", "package org;\nimport org.B;\nimport static java.util.List.of;\n// import org.A;\n", ("src/main/java/org/B.java",)),
    ("Go", "go/main.go", "package main\n\nimport (\n\t\"fmt\"\n\tb \"ex.org/m/p{g}/go/b\"\n)\n\nvar s = \"ex.org/m/p{g}/go/c\"\n", ("go/b/a.go",)), ("Go", "go/b/a.go", "package b\n", ()), ("Go", "go/b/z.go", "package b\n", ()), ("Go", "go/c/c.go", "package c\n", ()),
    ("Kotlin", "kt/src/org/k/C.kt", "package org.k\n\nimport org.k.D as E\nimport kotlin.math.*\n", ("kt/src/org/k/D.kt",)), ("Kotlin", "kt/src/org/k/D.kt", "package org.k\n", ()),
    ("Java", "src/main/java/org/B.java", "package org;\n", ()),
    ("JavaScript", "web/a.js", "import x, {\n  y,\n} from './b';\nexport * from './c.js';\nconst z = require('./lib');\nimport('./late').then(f);\n// import './d';\nimport React from 'react';\n", ("web/b.jsx", "web/c.js", "web/lib/index.js", "~web/late.js")),
    ("JavaScript", "web/b.jsx", "", ()), ("JavaScript", "web/c.js", "", ()), ("JavaScript", "web/lib/index.js", "", ()), ("JavaScript", "web/late.js", "", ()), ("JavaScript", "web/d.js", "", ()),
)
_PK_PLACES = ", ".join(f"({i}, '{p}')" for i, (_, p, *_) in enumerate(PACKAGES))
_PK_MEANT = ", ".join(f"('{p}', '{d.lstrip('~')}', {str(d.startswith('~')).lower()})" for _, p, _, means in PACKAGES for d in means)
_N = len(PACKAGES)


def packages(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    no, g = k % _N, F.floor(k / _N).cast("string")
    place = F.concat(F.lit("p"), g, F.lit("/"), _pick([c[1] for c in PACKAGES], no))
    return table(spark, sf_dir, "part").select(place.alias("path"), _pick([c[0] for c in PACKAGES], no).alias("language"), F.replace(_pick([c[2] for c in PACKAGES], no), F.lit("{g}"), g).alias("content"))


@_register(
    "SELECT concat(a.top, a.place) AS src, concat(b.top, b.place) AS dst, 'imports' AS kind, deferred FROM placed a JOIN meant USING (place) JOIN placed b ON a.top = b.top AND b.place = target",
    also=f"places(no, place) AS (VALUES {_PK_PLACES}), meant(place, target, deferred) AS (VALUES {_PK_MEANT}), placed AS (SELECT concat('p', p_partkey // {_N}, '/') AS top, place FROM part JOIN places ON p_partkey % {_N} = no)",
)
def package_import_edges(spark, sf_dir):
    f = packages(spark, sf_dir)
    return imports.edges(imports.resolved(imports.imports(f, "ex.org/m"), f))


# ---- symbols handed on ----------------------------------------------------------------------

_DEEP = 5  # files of a chain of re-exports: the last defines, the others hand on


def _chain(spark, sf_dir, gone: bool) -> DataFrame:
    """Chains m{g}_0 <- m{g}_1 <- ...: every file hands `run` on, by name, under another name, or with a star."""
    k = F.col("p_partkey")
    g, i = F.floor(k / _DEEP), k % _DEEP
    spec = F.concat(F.lit("'./m"), g, F.lit("_"), i - 1, F.lit("';\n"))
    kind = (g + i) % 3
    here, below = F.when(g % 2 == 0, "run").otherwise(F.concat(F.lit("run"), i)), F.when(g % 2 == 0, "run").otherwise(F.when(i == 1, "run0").otherwise(F.concat(F.lit("run"), i - 1)))
    by_name = F.concat(F.lit("export {\n  "), below, F.lit(" as "), here, F.lit(",\n} from "), spec)
    by_star = F.when(g % 2 == 0, F.concat(F.lit("export * from "), spec)).otherwise(by_name)
    handed = F.when(kind == 0, by_star).otherwise(by_name)
    first = F.when(F.lit(gone) & (g % 3 == 0), "export const other = 1;\n").otherwise(F.concat(F.lit("export function "), F.when(g % 2 == 0, "run").otherwise("run0"), F.lit("() {}\n")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), g, F.lit("_"), i, F.lit(".ts")).alias("path"), F.lit("TypeScript").alias("language"), F.when(i == 0, first).otherwise(handed).alias("content"))


_LINKS = f"links AS (SELECT p_partkey // {_DEEP} AS g, p_partkey % {_DEEP} AS i FROM part), handed AS (SELECT concat('src/m', g, '_', i, '.ts') AS path, CASE WHEN g % 2 = 0 THEN 'run' ELSE concat('run', i) END AS symbol, concat('src/m', g, '_0.ts') AS origin, g, i FROM links)"


@_register("SELECT path, symbol, origin, CASE WHEN g % 2 = 0 THEN 'run' ELSE 'run0' END AS origin_symbol FROM handed", also=_LINKS)
def symbol_closure(spark, sf_dir):
    f = _chain(spark, sf_dir, False)
    return symbols.of_files(f, imports.resolved(imports.imports(f), f))


@_register("SELECT concat('use/', g, '_', i, '.ts') AS importer, path AS dst, symbol, origin FROM handed WHERE g % 3 = 0", also=_LINKS)
def lost_symbols(spark, sf_dir):
    """A third of the chains loses its definition; each of their files is imported somewhere."""
    before, after = _chain(spark, sf_dir, False), _chain(spark, sf_dir, True)
    closed = [symbols.of_files(f, imports.resolved(imports.imports(f), f)) for f in (before, after)]
    k = F.col("p_partkey")
    g, i = F.floor(k / _DEEP), k % _DEEP
    used = table(spark, sf_dir, "part").select(F.concat(F.lit("use/"), g, F.lit("_"), i, F.lit(".ts")).alias("importer"), F.concat(F.lit("src/m"), g, F.lit("_"), i, F.lit(".ts")).alias("dst"), F.when(g % 2 == 0, "run").otherwise(F.concat(F.lit("run"), i)).alias("symbol"))
    return symbols.lost(*closed, used)


# ---- rings of imports -----------------------------------------------------------------------

_RING = "SELECT c_custkey // 6 AS g, c_custkey % 6 AS i, 2 + c_custkey // 6 % 5 AS s FROM customer"
_RINGS = f"""members AS (SELECT *, concat(CASE WHEN g % 5 = 0 AND i = 1 THEN 'tests/r' ELSE 'src/r' END, g, '_', i, CASE WHEN g % 2 = 0 THEN '.py' ELSE '.ts' END) AS path FROM ({_RING}) WHERE i < s),
whole AS (SELECT g, s, list(path ORDER BY i) AS nodes FROM members GROUP BY g, s HAVING count(*) = s),
told AS (SELECT *, g % 3 = 1 AS lazy, CASE WHEN g % 7 = 2 AND s > 2 THEN [nodes[1], nodes[s]] ELSE nodes END AS ring FROM whole WHERE g % 5 <> 0)"""


def _rings(spark, sf_dir) -> DataFrame:
    """(src, dst, deferred): rings of two to six files; some closed by a deferred import alone, some with a short cut."""
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 6).alias("g"), (F.col("c_custkey") % 6).alias("i")).withColumn("s", 2 + F.col("g") % 5).filter("i < s")
    whole = c.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")).filter("n = s").select("g")
    name = lambda i: F.concat(F.when((F.col("g") % 5 == 0) & (i == 1), "tests/r").otherwise("src/r"), "g", F.lit("_"), i, F.when(F.col("g") % 2 == 0, ".py").otherwise(".ts"))
    nxt = (F.col("i") + 1) % F.col("s")
    ring = c.join(whole, "g").select("g", "s", name(F.col("i")).alias("src"), name(nxt).alias("dst"), ((F.col("g") % 3 == 1) & (nxt == 0)).alias("deferred"))
    cut = c.join(whole, "g").filter("g % 7 = 2 AND s > 2 AND i = 0").select("g", "s", name(F.col("i")).alias("src"), name(F.col("s") - 1).alias("dst"), F.lit(False).alias("deferred"))
    return ring.unionByName(cut).select("src", "dst", "deferred")


@_register("SELECT 'architecture.circular-dependency' AS rule_id, ring[1] AS path, CASE WHEN lazy THEN 'LOW' ELSE 'HIGH' END AS severity, 1 AS line_start, array_to_string(ring, ' > ') AS ring, s AS size FROM told WHERE NOT lazy OR g % 2 = 0", also=_RINGS)
def circular_dependency_findings(spark, sf_dir):
    e = materialize(_rings(spark, sf_dir))
    p = F.col("path")
    files = e.select(F.explode(F.array("src", "dst")).alias("path")).distinct().select("path", paths.role(p).alias("role"))
    return cyclerules.circular_dependencies(e, files).withColumn("ring", F.array_join("nodes", " > ")).drop("nodes")


@_register("SELECT array_to_string(nodes, ' > ') AS cycle FROM whole WHERE g % 5 <> 0", also=_RINGS)
def component_cycles(spark, sf_dir):
    """Every ring is met once, from its smallest file; the short cuts are not, since a walk passes their ends before."""
    e = _rings(spark, sf_dir).filter("NOT (src LIKE 'tests/%' OR dst LIKE 'tests/%')")
    e = materialize(e)
    return cyclerules.cycles_met(e, materialize(graph.components_strong(e))).select(F.array_join("cycle", " > ").alias("cycle"))


@_register(
    "SELECT 'architecture.unresolved-local-import' AS rule_id, concat('u', p_partkey % 3, '/a', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.js' END) AS path, 'HIGH' AS severity, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 3 END AS line_start FROM part",
)
def unresolved_import_findings(spark, sf_dir):
    """One import a file means nothing; others are external, guarded or spoken of in comments and strings."""
    k = F.col("p_partkey")
    text = _pick((
        "import x from 'react';\nimport {\n  y,\n} from './gone';\n// import './other';\nexport const z = 'from ./no';\n", "import os\nimport gone.far\nfrom .missing import a\ntry:\n    from . import maybe\nexcept ImportError:\n    pass\n",
        "// mod far;\nmod gone;\n#[cfg(test)]\nmod tests;\nuse std::fmt;\n", "const r = require('fs');\nconst s = \"require('./x')\";\nconst t = require('../nowhere/at/all');\n",
    ), k % 4)
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("u"), k % 3, F.lit("/a"), k, _pick((".ts", ".py", ".rs", ".js"), k % 4)).alias("path"), _pick(("TypeScript", "Python", "Rust", "JavaScript"), k % 4).alias("language"), text.alias("content"))
    return cyclerules.unresolved_imports(imports.resolved(imports.imports(f), f))


# ---- long lists of patterns -----------------------------------------------------------------

#: Patterns by form ({k}: the part's number), and how SQL tells whether one fits the path of part k.
_FORMS = ("/d{m}/*", "m{k}.py", "/d{m}/**/m{k}.py", "*{k}.py", "/d{m}/in/m{k}.?s", "deep/")


@_register(
    "SELECT path, last, first FROM (SELECT k, concat('d', k % 9, CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '/in/' ELSE '/in/deep/er/' END, 'm', k, CASE WHEN k % 2 = 0 THEN '.py' ELSE '.ts' END) AS path FROM (SELECT p_partkey AS k FROM part)) f, LATERAL (SELECT max(no) AS last, min(no) AS first FROM fits WHERE fits.k = f.k) WHERE last IS NOT NULL",
    also="""rules AS (SELECT p_partkey AS no, p_partkey % 6 AS form, p_partkey // 6 AS t FROM part), keys AS (SELECT p_partkey AS k FROM part),
suffixes AS (SELECT k, CAST(substring(CAST(k AS VARCHAR), i) AS BIGINT) AS tail, substring(CAST(k AS VARCHAR), i) AS text FROM keys, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i) WHERE i <= length(CAST(k AS VARCHAR)) AND k % 2 = 0),
fits AS (SELECT k, no FROM keys JOIN rules ON form = 0 AND t % 9 = k % 9 UNION SELECT k, no FROM keys JOIN rules ON form IN (1, 2) AND t = k AND k % 2 = 0
         UNION SELECT s.k, no FROM suffixes s JOIN rules ON form = 3 AND t = tail AND text = CAST(t AS VARCHAR) UNION SELECT k, no FROM keys JOIN rules ON form = 4 AND t = k AND k % 2 = 1 AND k % 3 = 1
         UNION SELECT k, no FROM keys JOIN rules ON form = 5 AND k % 3 = 2)""",
)
def pattern_index_matches(spark, sf_dir):
    """A rule for each part, in six forms; the first and the last that fit each path."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("d"), k % 9, F.when(k % 3 == 0, "/").when(k % 3 == 1, "/in/").otherwise("/in/deep/er/"), F.lit("m"), k, F.when(k % 2 == 0, ".py").otherwise(".ts"))
    parts = table(spark, sf_dir, "part")
    t = F.floor(k / 6)
    glob = F.replace(F.replace(_pick(_FORMS, k % 6), F.lit("{k}"), t.cast("string")), F.lit("{m}"), (t % 9).cast("string"))
    rules = parts.select(k.alias("no"), glob.alias("glob"))
    both = patternindex.match(patternindex.match(parts.select(path.alias("path")), rules.withColumnRenamed("no", "last"), "last", "glob", last=True), rules.withColumnRenamed("no", "first"), "first", "glob")
    return both.filter("last IS NOT NULL")
