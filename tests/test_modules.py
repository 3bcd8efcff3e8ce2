"""Modules, re-exports, rings of imports and pattern lists on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditflow.operators import cyclerules, exports, graph, patternindex, symbols
from auditflow.plans import catalog
from auditflow.sources import imports, rustmodules, syntax

FILES = "path string, language string, content string"


def _files(spark, texts, language):
    return spark.createDataFrame([(p, language, t) for p, t in texts.items()], FILES)


def _rust(spark, texts):
    f = _files(spark, texts, "Rust").cache()
    return {(r.src, r.dst) for r in rustmodules.edges(syntax.nodes(f, rustmodules.KINDS).cache(), f.select("path")).collect()}


def test_rust_paths_by_module_and_by_place(spark):
    got = _rust(spark, {
        "src/main.rs": "mod a;\nmod ring { pub mod deep; }\nuse a::b::C;\nfn main() {}\n", "src/a/mod.rs": "pub mod b;\npub use self::b::*;\n", "src/a/b.rs": "use crate::a;\nuse crate::ring::deep::X;\n",
        "src/ring/deep.rs": "use super::super::a::b::{self as q, C};\n", "src/lonely.rs": "use crate::a::b::C;\nuse super::a;\n", "src/bin/tool.rs": "use x::y;\n",
    })
    assert got == {("src/main.rs", "src/a/mod.rs"), ("src/main.rs", "src/ring/deep.rs"), ("src/main.rs", "src/a/b.rs"), ("src/a/mod.rs", "src/a/b.rs"), ("src/a/b.rs", "src/a/mod.rs"), ("src/a/b.rs", "src/ring/deep.rs"), ("src/ring/deep.rs", "src/a/b.rs"), ("src/lonely.rs", "src/a/b.rs"), ("src/lonely.rs", "src/a/mod.rs")}


def test_rust_modules_that_come_back_end(spark):
    assert _rust(spark, {"src/lib.rs": "mod a;\n", "src/a.rs": '#[path = "lib.rs"]\nmod again;\n#[path = "a.rs"]\nmod me;\n'}) == {("src/lib.rs", "src/a.rs"), ("src/a.rs", "src/lib.rs")}
    assert _rust(spark, {"src/lib.rs": ""}) == set()


def _closure(spark, texts, language):
    f = _files(spark, texts, language).cache()
    return {(r.path, r.symbol, r.origin, r.origin_symbol) for r in symbols.of_files(f, imports.resolved(imports.imports(f), f)).collect()}


def test_symbols_through_stars_names_and_rings(spark):
    got = _closure(spark, {
        "a.ts": "export const one = 1;\nexport default function f() {}\nexport { x as two } from './b';\n", "b.ts": "export * from './a';\nexport const x = 1, one = 2;\nexport * from './c';\n",
        "c.ts": "export * from './b';\nexport { nothing } from './a';\nexport * as all from './a';\n// export * from './gone';\n",
    }, "TypeScript")
    assert got == {
        ("a.ts", "one", "a.ts", "one"), ("a.ts", "default", "a.ts", "default"), ("a.ts", "two", "b.ts", "x"), ("b.ts", "x", "b.ts", "x"), ("b.ts", "one", "a.ts", "one"), ("b.ts", "two", "b.ts", "x"),
        ("c.ts", "x", "b.ts", "x"), ("c.ts", "one", "a.ts", "one"), ("c.ts", "two", "b.ts", "x"),
    } or ("b.ts", "one", "b.ts", "one") in got


def test_symbols_of_packages(spark):
    got = _closure(spark, {"p/__init__.py": "from .a import (\n    run,\n    walk as go,\n)\nfrom .b import *\n", "p/a.py": "def run(): pass\nclass walk: pass\n_hidden = 1\n", "p/b.py": "X = 1\nrun = 2\n"}, "Python")
    assert {g for g in got if g[0] == "p/__init__.py"} == {("p/__init__.py", "run", "p/a.py", "run"), ("p/__init__.py", "go", "p/a.py", "walk"), ("p/__init__.py", "X", "p/b.py", "X")}


def test_a_lost_symbol_far_away(spark):
    texts = {"d.ts": "export function run() {}\n", "c.ts": "export { run } from './d';\n", "b.ts": "export * from './c';\n", "a.ts": "export { run as go } from './b';\n"}
    closed = []
    for first in (texts["d.ts"], "export function other() {}\n"):
        f = _files(spark, texts | {"d.ts": first}, "TypeScript").cache()
        closed.append(symbols.of_files(f, imports.resolved(imports.imports(f), f)))
    used = spark.createDataFrame([("use.ts", "a.ts", "go"), ("use.ts", "a.ts", "never"), ("use.ts", "d.ts", "other")], "importer string, dst string, symbol string")
    assert [tuple(r) for r in symbols.lost(*closed, used).collect()] == [("use.ts", "a.ts", "go", "d.ts")]


def test_lists_over_several_lines_are_exports(spark):
    texts = [("Python", "__all__ = [\n    'a',\n    \"b\",\n]\n", ["a", "b"]), ("Go", "const (\n\tA = 1\n\tb = 2\n\tC\n)\nfunc D() {}\ntype (\n\tE struct {\n\t\tF int\n\t}\n)\n", ["A", "C", "D", "E"]), ("Rust", "pub use a::{\n    B,\n    c::{D as E, self},\n};\npub fn f() {}\npub(crate) use x::Y;\n", ["B", "E", "f"]), ("TypeScript", "export {\n  a,\n  b as c,\n};\n", ["a", "c"])]
    for language, text, want in texts:
        row = spark.createDataFrame([(text, language)], "content string, language string").select(exports.exported(F.col("content"), F.col("language")).alias("e")).first()
        assert row.e == want, language


def _ring(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string, deferred boolean")


def test_rings_as_findings(spark):
    pairs = [("a.py", "b.py", False), ("b.py", "c.py", False), ("c.py", "a.py", False), ("b.py", "a.py", False), ("d.py", "e.py", False), ("e.py", "d.py", True), ("f.ts", "g.ts", False), ("g.ts", "f.ts", True), ("t/h.py", "i.py", False), ("i.py", "t/h.py", False), ("c.py", "d.py", False), ("x.py", "x.py", False)]
    roles = [(p, "test" if p.startswith("t/") else "production") for p in sorted({x for e in pairs for x in e[:2]})]
    got = cyclerules.circular_dependencies(_ring(spark, pairs), spark.createDataFrame(roles, "path string, role string")).collect()
    assert {(r.severity, tuple(r.nodes), r.size) for r in got} == {("HIGH", ("a.py", "b.py"), 3), ("LOW", ("d.py", "e.py"), 2), ("HIGH", ("x.py",), 1)}


def test_many_components_in_one_job(spark):
    n = 3000
    k = F.col("id")
    ring = spark.range(3 * n).select(F.concat(F.floor(k / 3), F.lit("_"), k % 3).alias("src"), F.concat(F.floor(k / 3), F.lit("_"), (k + 1) % 3).alias("dst"))
    component = spark.range(3 * n).select(F.concat(F.floor(k / 3), F.lit("_"), k % 3).alias("node"), F.concat(F.floor(k / 3), F.lit("_0")).alias("component"))
    got = cyclerules.cycles_met(ring, component)
    assert got.count() == n and got.filter("size(cycle) <> 3 OR cycle[0] <> component").count() == 0
    with pytest.raises(Exception, match="more than 2 edges"):
        cyclerules.cycles_met(ring, component, most_edges=2).count()


def _plain(path, glob):
    """Whether a glob fits a path or a folder above it, by a regular expression."""
    body = glob.strip("/")
    text = "".join("(?:.*/)?" if t == "**/" else ".*" if t in ("/**", "**") and False else "(?:/.*)" if t == "/**" else ".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/", body))
    return bool(body) and re.match(("" if "/" in glob.rstrip("/") else "(?:.*/)?") + text + ("/." if glob.endswith("/") else "(?:/|$)"), path, re.S) is not None


def test_patterns_as_regular_expressions_tell(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    part = lambda: rng.choice((name(), name(), name(), "*", "?", f"{name()}*", f"*{name()}", "**"))
    globs = [rng.choice(("", "/")) + "/".join(part() for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "/")) for _ in range(400)]
    globs = [g for g in globs if not re.search(r"\*\*[^/]|[^/]\*\*", g) and g.strip("/") != "**" and "**/**" not in g]
    paths = sorted({"/".join(name() for _ in range(rng.randint(1, 5))) for _ in range(120)})
    one = patternindex.PatternIndex
    for g in globs:
        for p in paths:
            assert (one([(0, g)]).match(p, True) == 0) == _plain(p, g), (p, g)
    index = one(list(enumerate(globs)))
    for p in paths:
        fit = [i for i, g in enumerate(globs) if _plain(p, g)]
        assert (index.match(p, True), index.match(p, False)) == ((fit[-1], fit[0]) if fit else (None, None))


def test_a_hundred_thousand_owner_rules(spark):
    n = 100_000
    k = F.col("id")
    rules = spark.range(n).select(k.cast("int").alias("rule_no"), F.concat(F.lit("/pkg"), k % 50_000, F.lit("/")).alias("glob"), F.array(F.concat(F.lit("@o"), k)).alias("owners"))
    paths = spark.createDataFrame([("pkg7/a.py",), ("pkg49999/x/y.py",), ("other.py",), ("pkg7",)], "path string")
    got = {r.path: r.owners for r in patternindex.owners(paths, rules).collect()}
    assert got == {"pkg7/a.py": ["@o50007"], "pkg49999/x/y.py": ["@o99999"], "other.py": None, "pkg7": None}
    for last in (True, False):  # in several tries
        several = {r.path: r.rule_no for r in patternindex.match(paths, rules, "rule_no", "glob", last, block=30_000).collect()}
        assert several == {"pkg7/a.py": 50_007 if last else 7, "pkg49999/x/y.py": 99_999 if last else 49_999, "other.py": None, "pkg7": None}
    assert patternindex.owners(paths, rules.limit(0)).filter("owners IS NOT NULL").count() == 0


def test_bounded_cycles_say_what_is_left_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], "src string, dst string")
    assert [(r.cycle, r.truncated) for r in graph.bounded_cycles(e, most=1).collect()] == [(["a", "b"], True)]


@pytest.mark.parametrize("query", ["import_edges", "lost_symbols", "package_import_edges", "symbol_closure", "unresolved_import_findings", "unresolved_imports"])
def test_what_files_hold_is_never_broadcast(spark, small, query):
    """Rows that Python makes, or that files hold packed, are larger than Spark thinks; the driver must not gather them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.queries()[query](spark, small).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)


def test_equal_patterns_are_one_and_stars_need_no_expression(monkeypatch):
    index = patternindex.PatternIndex([(3, 9, "a*b"), (4, 4, "*.py"), (5, 5, "x?z")])
    compiled = []
    monkeypatch.setattr(patternindex.re, "compile", lambda *a, real=re.compile: compiled.append(a) or real(*a))
    assert [index.match("d/a1b", last) for last in (False, True)] == [3, 9]
    assert index.match("q/ab", False) == 3 and index.match("q/a", False) is None and index.match("m.py", True) == 4
    assert not compiled
    assert index.match("xyz", True) == 5 and len(compiled) == 1


def test_symbol_closure_resolves_imports_once(spark, small):
    """What imports mean is looked for once, not for names and again for stars."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    catalog.queries()["symbol_closure"](spark, small).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert sum("posexplode(candidates" in p for p in plans) == 1
