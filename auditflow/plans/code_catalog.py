"""Queries on source files: rules on lines, functions, imports, exports and tests.

SQL knows what was planted in each line of rel.SNIPPETS and in the texts below, not the patterns
that find it, so a wrong pattern shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..operators import behavior, exports, functionrules, graph, mobilerules, review, security, taint, testing, textrules
from ..sources import imports, repository, spans, syntax
from . import relations as rel
from .catalog import _register
from .storage import table

_RULES = "'architecture.deep-relative-imports', 'secret', 'security.private-key-candidate', 'code-marker.todo', 'code-marker.fixme', 'code-marker.hack'"


@_register(f"SELECT rule_id, path, severity, line_start FROM planted WHERE rule_id NOT IN ({_RULES})", "code")
def line_rule_findings(spark, sf_dir):
    return textrules.line_rules(rel.code(spark, sf_dir))


@_register("SELECT rule_id, path, severity, line_start FROM planted WHERE starts_with(rule_id, 'code-marker.')", "code")
def marker_findings(spark, sf_dir):
    return textrules.markers(rel.code(spark, sf_dir))


@_register("SELECT rule_id, path, severity, line_start FROM planted WHERE rule_id = 'security.private-key-candidate'", "code")
def private_key_findings(spark, sf_dir):
    return textrules.private_keys(rel.code(spark, sf_dir))


@_register("SELECT path, line_start, severity AS confidence FROM planted WHERE rule_id = 'secret'", "code")
def secret_findings(spark, sf_dir):
    return security.secret_lines(rel.code(spark, sf_dir))


@_register("SELECT rule_id, path, severity, min(line_start) AS line_start FROM planted WHERE rule_id = 'architecture.deep-relative-imports' GROUP BY ALL", "code")
def deep_import_findings(spark, sf_dir):
    return textrules.deep_imports(rel.code(spark, sf_dir))


@_register("SELECT 'architecture.deep-directory-nesting' AS rule_id, path, 'LOW' AS severity, 1 AS line_start FROM code WHERE contains(path, '/a/b/c/d/e/')", "code")
def deep_directory_findings(spark, sf_dir):
    return textrules.deep_directories(rel.code(spark, sf_dir))


@_register("SELECT 'architecture.too-many-modules' AS rule_id, regexp_replace(path, '/[^/]*$', '') AS path, 'MEDIUM' AS severity, 1 AS line_start FROM code GROUP BY ALL HAVING count(*) > 20", "code")
def crowded_directory_findings(spark, sf_dir):
    return textrules.crowded_directories(rel.code(spark, sf_dir))


@_register("SELECT path, CASE WHEN contains(path, '/tests/') THEN 'test' ELSE 'production' END AS role, contains(path, '/tests/') AS is_test, false AS config, false AS generated, false AS public, language AS named FROM code", "code")
def code_roles(spark, sf_dir):
    p = F.col("path")
    return rel.code(spark, sf_dir).select("path", paths.role(p).alias("role"), paths.test_file(p).alias("is_test"), paths.config_file(p).alias("config"), paths.generated_file(p).alias("generated"), paths.public_api(p).alias("public"), paths.language(p).alias("named"))


# ---- paths with a name for each case --------------------------------------------------------

#: Names by what they stand for: path, coarse role, public, entrypoint, low signal, reached without import, module kind, boundary.
NAMES = (
    ("src/lib.rs", "production", True, False, False, False, "unknown", None), ("src/main.rs", "production", False, True, False, False, "unknown", None), ("web/package.json", "config", False, False, False, False, "unknown", "supply-chain"),
    ("gen/api.ts", "generated", False, False, True, False, "unknown", None), ("fixtures/a.py", "fixture", False, False, True, False, "unknown", None), ("docs/guide.md", "documentation", False, False, False, False, "unknown", None), ("pkg/x_test.go", "test", False, False, True, False, "unknown", None),
    ("src/ui/Button.tsx", "production", False, False, False, False, "ui", None), ("src/infra/db.py", "production", False, False, False, False, "infrastructure", None), ("src/domain/order.rs", "production", False, False, False, False, "domain", None), ("src/cli/run.rs", "production", False, False, False, False, "cli", None),
    ("app/page.tsx", "production", False, False, False, True, "unknown", None), ("src/search.worker.ts", "production", False, False, False, True, "unknown", None), ("eslint.config.mjs", "production", False, False, False, True, "unknown", None), ("shop/migrations/0001_x.py", "production", False, False, False, True, "unknown", None),
    ("shop/management/commands/go.py", "production", False, False, False, True, "unknown", None), ("types/a.d.ts", "production", False, False, False, True, "unknown", None), ("vendor/lib/a.js", "production", False, False, False, True, "unknown", None), ("scripts/run.py", "production", False, False, False, True, "unknown", None),
    ("settings.gradle.kts", "production", False, False, False, True, "unknown", None), ("bin/tool.js", "production", False, False, False, True, "unknown", None), ("pkg/__init__.py", "production", False, False, False, True, "unknown", None), ("src/components/page.tsx", "production", False, False, False, False, "ui", None),
    (".github/workflows/ci.yml", "production", False, False, False, False, "unknown", "deploy-surface"), ("ops/main.tf", "production", False, False, False, False, "unknown", "deploy-surface"), (".env.local", "production", False, False, False, False, "unknown", "secret-config"), ("src/corsSetup.ts", "production", False, False, False, False, "unknown", "request-trust"),
    ("src/userLogin.ts", "production", False, False, False, False, "unknown", "access-control"), ("src/authors.ts", "production", False, False, False, False, "unknown", None), ("src/oauth2.py", "production", False, False, False, False, "unknown", "access-control"), ("Cargo.lock", "config", False, False, False, False, "unknown", "supply-chain"),
)
_KINDS = {"ui": [r"(^|/)(ui|components)/"], "infrastructure": [r"(^|/)infra/"], "domain": [r"(^|/)domain/"], "cli": [r"(^|/)cli/"]}
_text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v + "'"
_NAME_ROWS = ", ".join(f"({i}, {', '.join(map(_text, r))})" for i, r in enumerate(NAMES))
_NAMED = f"names(no, name, role, public, entrypoint, low, reached, kind, boundary) AS (VALUES {_NAME_ROWS}), named AS (SELECT p_partkey, n.* FROM part JOIN names n ON p_partkey % {len(NAMES)} = n.no)"


def _named(spark, sf_dir) -> DataFrame:
    """A name for each part, below a directory of its own."""
    known = F.array(*(F.lit(r[0]) for r in NAMES))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(known, (F.col("p_partkey") % len(NAMES)).cast("int")).alias("path"))


@_register("SELECT p_partkey, role, public, entrypoint, low, reached, kind FROM named", also=_NAMED)
def path_classes(spark, sf_dir):
    p = F.col("path")
    entry = F.lower(paths.base_name(p)).isin(*paths.ENTRYPOINTS)
    return _named(spark, sf_dir).select("p_partkey", paths.role(p).alias("role"), paths.public_api(p).alias("public"), entry.alias("entrypoint"), paths.low_signal(p).alias("low"), graph.reached_without_import(p).alias("reached"), paths.module_kind(p, _KINDS).alias("kind"))


@_register("SELECT p_partkey, boundary FROM named WHERE role NOT IN ('test', 'fixture')", also=_NAMED)
def boundary_of_names(spark, sf_dir):
    p = F.col("path")
    return _named(spark, sf_dir).filter(~paths.test_file(p)).select("p_partkey", review.boundary(p).alias("boundary"))


_PATHS = (("./a//b/../c.ts", "a/b/../c.ts", "a/c.ts", "b/../c.ts", 2), (r"a\b\c", "a/b/c", None, "b/c", 1), ("../x/./y", "../x/./y", "x/y", "../x/./y", 3), ("a", "a", "a", ".", 0), ("", ".", None, ".", 0), ("a/..//..", "a/../..", "", "../..", 1))
_PATH_ROWS = ", ".join(f"({i}, {_text(r[1])}, {_text(r[2])}, {_text(r[3])})" for i, r in enumerate(_PATHS))


@_register(f"SELECT event_id, cleaned, normal, below FROM events JOIN (VALUES {_PATH_ROWS}) t(no, cleaned, normal, below) ON event_id % {len(_PATHS)} = t.no")
def path_forms(spark, sf_dir):
    known = F.array(*(F.lit(r[0]) for r in _PATHS))
    p = F.get(known, (F.col("event_id") % len(_PATHS)).cast("int"))
    none = F.get(F.array(*(F.lit(r[2] is None) for r in _PATHS)), (F.col("event_id") % len(_PATHS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", paths.clean(p).alias("cleaned"), F.when(~none, paths.normalised(paths.clean(p))).alias("normal"), paths.relative(p, "a").alias("below"))


# ---- functions ------------------------------------------------------------------------------

#: Functions by language: a text, and (name, first, last, score, depth, loops, recursive) of each function in it.
FUNCTIONS = (
    ("py", "Python", "def plain(x):\n    return x\n\ndef deep(a):\n    if a and b:\n        for i in a:\n            while i:\n                if i:\n                    for j in i:\n                        deep(j)\n    elif c:\n        return 1\n", (("plain", 1, 2, 0, 0, 0, False), ("deep", 4, 12, 16, 5, 3, True))),
    ("rs", "Rust", "fn flat(x: u8) -> u8 {\n    match x {\n        1 => 2,\n        _ => 3,\n    }\n}\npub fn nest() {\n    loop {\n        if a || b {\n            return;\n        } else if c {\n            go();\n        }\n    }\n}\n", (("flat", 1, 6, 1, 1, 0, False), ("nest", 7, 15, 5, 2, 1, False))),
    ("ts", "TypeScript", "export const run = (a) => {\n  if (a) {\n    return a && a.b;\n  }\n};\nfunction again(n) {\n  for (const x of n) {\n    for (const y of x) {\n      again(y);\n    }\n  }\n}\n", (("run", 1, 5, 2, 1, 0, False), ("again", 6, 12, 3, 2, 2, True))),
    ("go", "Go", "func Walk(n int) {\n\tfor i := 0; i < n; i++ {\n\t\tif i > 1 {\n\t\t\tWalk(i)\n\t\t}\n\t}\n}\n", (("Walk", 1, 7, 3, 2, 1, True),)),
    ("java", "Java", "class A {\n  @Get(\"x\")\n  public int of(int a) {\n    try { return a; } catch (E e) { if (a > 1) { return 2; } }\n    return 0;\n  }\n}\n", (("of", 2, 6, 3, 2, 0, False),)),
)
_FUNCTION_ROWS = ", ".join(f"({i}, '{n}', {a}, {b}, {s}, {d}, {lo}, {str(r).lower()})" for i, (_, _, _, fs) in enumerate(FUNCTIONS) for n, a, b, s, d, lo, r in fs)
_SPANS = f"spans(no, name, f, l, score, depth, loops, recursive) AS (VALUES {_FUNCTION_ROWS})"
_PADDED = "s_suppkey % 7 * 12"  # blank lines that a function's file begins with


def _functions(spark, sf_dir) -> DataFrame:
    """A file of functions for each supplier, blank lines first."""
    no = (F.col("s_suppkey") % len(FUNCTIONS)).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(f[i]) for f in FUNCTIONS)), no)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("src/f"), "s_suppkey", F.lit("."), pick(0)).alias("path"), pick(1).alias("language"), F.concat(F.repeat(F.lit("\n"), F.expr(_PADDED).cast("int")), pick(2)).alias("content"))


_SPANNED = f"{_SPANS}, spanned AS (SELECT s_suppkey, concat('src/f', s_suppkey, '.', CASE s_suppkey % {len(FUNCTIONS)} " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(FUNCTIONS)) + f" END) AS path, name, f + {_PADDED} AS first, l + {_PADDED} AS last, l - f + 1 AS lines, score, depth, loops, recursive FROM supplier JOIN spans ON s_suppkey % {len(FUNCTIONS)} = no)"


@_register("SELECT path, name, CAST(first AS INT) AS first, CAST(last AS INT) AS last, lines, score, depth, loops, recursive FROM spanned", also=_SPANNED)
def function_spans(spark, sf_dir):
    return spans.functions(_functions(spark, sf_dir)).drop("language")


def _role_of(files: DataFrame) -> DataFrame:
    return files.select("path", paths.role(F.col("path")).alias("role"))


@_register("SELECT 'code-quality.long-function' AS rule_id, path, 'MEDIUM' AS severity, CAST(first AS INT) AS line_start FROM spanned WHERE lines > 8", also=_SPANNED)
def long_function_findings(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return functionrules.long_functions(spans.functions(f), _role_of(f), most=8)


@_register("SELECT 'code-quality.complex-function' AS rule_id, path, 'MEDIUM' AS severity, CAST(first AS INT) AS line_start FROM spanned WHERE score > 15", also=_SPANNED)
def complex_function_findings(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return functionrules.complex_functions(spans.functions(f), _role_of(f))


@_register("SELECT 'code-quality.deep-control-flow' AS rule_id, path, 'LOW' AS severity, CAST(first + 5 AS INT) AS line_start FROM spanned WHERE depth > 4", also=_SPANNED)
def deep_control_flow_findings(spark, sf_dir):
    """The fifth structure of the deep function, five lines below its first."""
    f = _functions(spark, sf_dir)
    return functionrules.deep_control_flow(syntax.nodes(f, ("control",)), _role_of(f))


@_register("SELECT path, name, CAST(first AS INT) AS first, kind FROM (SELECT *, unnest(list_filter([CASE WHEN depth >= 3 THEN 'nesting-increased' END, CASE WHEN loops >= 2 THEN 'nested-loop-added' END, CASE WHEN recursive THEN 'recursion-added' END], lambda x: x IS NOT NULL)) AS kind FROM spanned WHERE s_suppkey % 2 = 0)", also=_SPANNED)
def algorithmic_changes(spark, sf_dir):
    """Functions of even suppliers are new; all their files' lines changed."""
    f = _functions(spark, sf_dir)
    after = spans.functions(f)
    before = spans.functions(f.filter("s_suppkey % 2 = 1"))
    ranges = f.select("path", F.lit(1).alias("start"), F.lit(10_000).alias("stop"))
    return functionrules.algorithmic_changes(before, after, ranges)


_FILE_LINES = "len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S')))"
_DENSE = "dense AS (SELECT concat('src/dense', s_suppkey, '.ts') AS path, 10 + s_suppkey % 30 AS lines, s_suppkey % 14 AS branches FROM supplier)"


@_register("SELECT 'code-quality.complex-file' AS rule_id, path, CASE WHEN branches * 1000 // lines >= 400 AND lines >= 25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 1 AS line_start FROM dense WHERE branches * 1000 // lines >= 200", also=_DENSE)
def complex_file_findings(spark, sf_dir):
    n, b = F.col("s_suppkey") % 30 + 10, F.col("s_suppkey") % 14
    body = F.concat(F.repeat(F.lit("if (a) { b(); }\n"), F.least(n, b).cast("int")), F.repeat(F.lit("x();\n"), F.greatest(n - b, F.lit(0)).cast("int")))
    f = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/dense"), "s_suppkey", F.lit(".ts")).alias("path"), body.alias("content"))
    return textrules.complex_files(repository.measured(f))


@_register("SELECT path, function, kind, line, source FROM (SELECT concat('src/t', s_suppkey, '.py') AS path, unnest([{'function': 'view', 'kind': 'taint-sql', 'line': 3, 'source': 'http-request'}, {'function': 'tool', 'kind': 'taint-exec', 'line': 10, 'source': 'process-args'}], recursive := true) FROM supplier)")
def taint_flows(spark, sf_dir):
    body = "def view(request):\n    name = request.args['n']\n    db.execute(f'select {name}')\n    number = int(name)\n    db.execute('select ?', name)\n    db.execute(f'select {number}')\n\ndef tool():\n    cmd = 'run ' + sys.argv[1]\n    os.system(cmd)\n    cmd = 'fixed'\n    os.system(cmd)\n"
    f = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/t"), "s_suppkey", F.lit(".py")).alias("path"), F.lit("Python").alias("language"), F.lit(body).alias("content"))
    return taint.taint(f)


# ---- imports, exports and tests -------------------------------------------------------------

_MODULES = "modules AS (SELECT p_partkey AS k, concat('src/m', p_partkey, '.ts') AS path, concat('src/m', p_partkey * 7 % 1000 + 1, '.ts') AS target, p_partkey % 5 = 0 AS lazy, p_partkey % 6 = 0 AS bare FROM part)"


def _modules(spark, sf_dir) -> DataFrame:
    """A module for each part, which imports another one, maybe missing, lazily or from a package."""
    other = F.col("p_partkey") * 7 % 1000 + 1
    local = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("const m = await import('./m"), other, F.lit("');"))).otherwise(F.concat(F.lit("import { run, type Shape as S } from './m"), other, F.lit("';")))
    package = F.when(F.col("p_partkey") % 6 == 0, F.lit("\nimport React from 'react';")).otherwise("")
    own = F.lit("\nexport function run() {}\nexport const alone = 1;\nexport { a as first, second };\nexport default run;\n")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), "p_partkey", F.lit(".ts")).alias("path"), F.lit("TypeScript").alias("language"), F.concat(local, package, own).alias("content"))


@_register("SELECT m.path AS src, t.path AS dst, 'imports' AS kind, m.lazy AS deferred FROM modules m JOIN modules t ON t.path = m.target WHERE m.path <> t.path", also=_MODULES)
def import_edges(spark, sf_dir):
    f = _modules(spark, sf_dir)
    return imports.edges(imports.resolved(imports.imports(f), f))


@_register("SELECT 'ts' AS ext, 'relative-path' AS kind, count(*) AS n FROM modules WHERE target NOT IN (SELECT path FROM modules) HAVING count(*) > 0", also=_MODULES)
def unresolved_imports(spark, sf_dir):
    f = _modules(spark, sf_dir)
    return exports.unresolved_totals(imports.resolved(imports.imports(f), f), f)


@_register("SELECT path, unnest(['run', 'alone', 'first', 'second', 'default']) AS symbol FROM modules", also=_MODULES)
def exported_symbols(spark, sf_dir):
    return exports.exports(_modules(spark, sf_dir))


@_register("SELECT path AS importer, concat('./', regexp_extract(target, '(m[0-9]+)', 1)) AS spec, unnest(['run', 'Shape']) AS symbol FROM modules WHERE NOT lazy UNION ALL SELECT path, 'react', 'default' FROM modules WHERE bare", also=_MODULES)
def named_imports(spark, sf_dir):
    return exports.named_imports(_modules(spark, sf_dir))


_TESTED = "tested AS (SELECT p_partkey AS k, concat('pkg', p_partkey % 9, '/u', p_partkey, '.py') AS path, CASE WHEN p_partkey % 3 = 0 THEN concat('pkg', p_partkey % 9, '/test_u', p_partkey, '.py') WHEN p_partkey % 3 = 1 THEN concat('pkg', p_partkey % 9, '/tests/u', p_partkey, '_test.py') END AS test, p_partkey % 10 = 2 AS inline FROM part)"


def _tested(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    dir_ = F.concat(F.lit("pkg"), k % 9)
    own = F.struct(F.concat(dir_, F.lit("/u"), k, F.lit(".py")).alias("path"), F.when(k % 10 == 2, "def test_it():\n    pass\n").otherwise("x = 1\n").alias("content"))
    test = F.when(k % 3 == 0, F.concat(dir_, F.lit("/test_u"), k, F.lit(".py"))).when(k % 3 == 1, F.concat(dir_, F.lit("/tests/u"), k, F.lit("_test.py")))
    both = F.array(own, F.when(test.isNotNull(), F.struct(test.alias("path"), F.lit("").alias("content"))))
    return table(spark, sf_dir, "part").select(F.explode(F.array_compact(both)).alias("f")).select("f.path", paths.language(F.col("f.path")).alias("language"), "f.content")


@_register("SELECT test AS src, path AS dst, 'test-of' AS kind, false AS deferred FROM tested WHERE test IS NOT NULL", also=_TESTED)
def test_of_edges(spark, sf_dir):
    return testing.test_edges(_tested(spark, sf_dir))


@_register("SELECT path FROM tested WHERE test IS NULL AND NOT inline", also=_TESTED)
def sources_without_test(spark, sf_dir):
    f = testing.with_inline_tests(_tested(spark, sf_dir)).withColumn("role", paths.role(F.col("path")))
    return testing.without_test(f)


@_register("SELECT NOT bool_or(contains(test, '/tests/')) AS missing FROM tested", also=_TESTED)
def missing_test_folder(spark, sf_dir):
    return testing.missing_test_folder(_tested(spark, sf_dir))


# ---- what changed lines do ------------------------------------------------------------------

#: Added lines by the behaviour they add, null for none.
ADDED = (
    ("subprocess.run(cmd)", "subprocess-added"), ("r = requests.get(url)", "network-call-added"), ("open(p, 'w').write(x)", "fs-write-added"), ("key = os.getenv('K')", "env-var-introduced"), ("q = 'select a from t where b'", "raw-sql-added"),
    ("import numpy as np", "dependency-import-added"), ("from own.thing import x", None), ("from . import sibling", None), ("total = a + b", None), ("# subprocess.run(cmd)", None),
)
_ADDED_ROWS = ", ".join(f"({i}, {_text(k)})" for i, (_, k) in enumerate(ADDED))


@_register(f"SELECT concat('src/c', event_id % 50, '.py') AS path, kind, CAST(event_id AS INT) AS line FROM events JOIN (VALUES {_ADDED_ROWS}) t(no, kind) ON event_id % {len(ADDED)} = no WHERE kind IS NOT NULL AND event_id % 4 <> 3")
def behavior_added(spark, sf_dir):
    e = F.col("event_id")
    texts = F.array(*(F.lit(x) for x, _ in ADDED))
    lines = table(spark, sf_dir, "events").select(
        F.when(e % 4 == 3, F.concat(F.lit("tests/c"), e % 50, F.lit(".py"))).otherwise(F.concat(F.lit("src/c"), e % 50, F.lit(".py"))).alias("path"), F.lit("added").alias("side"), e.cast("int").alias("line"), F.get(texts, (e % len(ADDED)).cast("int")).alias("text"),
    )
    return behavior.added(lines, spark.createDataFrame([("own",)], "name string"))


@_register("SELECT path, kind FROM (SELECT CASE WHEN event_id % 4 = 2 THEN concat('tests/test_d', event_id, '.py') ELSE concat('src/d', event_id, '.py') END AS path, CASE event_id % 4 WHEN 0 THEN 'error-handling-removed' WHEN 1 THEN 'auth-check-removed' WHEN 2 THEN 'test-deleted-or-emptied' END AS kind FROM events) WHERE kind IS NOT NULL")
def behavior_removed(spark, sf_dir):
    e = F.col("event_id")
    path = F.when(e % 4 == 2, F.concat(F.lit("tests/test_d"), e, F.lit(".py"))).otherwise(F.concat(F.lit("src/d"), e, F.lit(".py")))
    case = lambda *v: F.get(F.array(*map(F.lit, v)), (e % 4).cast("int"))
    t = table(spark, sf_dir, "events")
    before = t.select(path.alias("path"), case("try:\n    a()\nexcept E:\n    pass\n", "@login_required\ndef a(): pass\n", "def test_a(): pass\n", "try:\n    a()\nexcept E:\n    b()\n").alias("content"))
    after = t.filter("event_id % 4 <> 2").select(path.alias("path"), case("a()\n", "def a(): pass\n", "", "try:\n    a()\nexcept E:\n    c()\n").alias("content"))
    return behavior.removed(before, after)


@_register("SELECT count(*) FILTER (event_id % 5 = 0) > 0 AND count(*) FILTER (event_id % 5 = 9) = 0 AS missing FROM events")
def boundary_without_test(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    signals = t.select(F.when(F.col("event_id") % 5 == 0, "access-control").alias("boundary"))
    return behavior.missing_test(signals, t.select(F.concat(F.lit("src/x"), "event_id", F.lit(".ts")).alias("path")))


# ---- rules on projects ----------------------------------------------------------------------

_DEPS = "deps AS (SELECT s_suppkey AS k, concat('app', s_suppkey) AS root, s_suppkey % 4 AS a, s_suppkey % 3 AS b FROM supplier)"


@_register(
    "SELECT rule_id, concat(root, '/package.json') AS path, severity, 1 AS line_start FROM (SELECT root, unnest(list_filter([CASE WHEN b = 0 THEN {'rule_id': 'framework.rn-async-storage-legacy', 'severity': 'MEDIUM'} END, CASE WHEN a >= 2 AND b = 1 THEN {'rule_id': 'framework.rn-navigation-compat', 'severity': 'HIGH'} END,"
    " CASE WHEN a >= 2 AND b = 2 THEN {'rule_id': 'framework.rn-reanimated-compat', 'severity': 'HIGH'} END, CASE WHEN a >= 1 AND b = 1 THEN {'rule_id': 'framework.rn-gesture-handler-old', 'severity': 'HIGH'} END, CASE WHEN b = 2 THEN {'rule_id': 'framework.rn-new-arch-incompatible-dep', 'severity': 'MEDIUM'} END], lambda x: x IS NOT NULL), recursive := true) FROM deps)",
    also=_DEPS,
)
def mobile_dependency_findings(spark, sf_dir):
    """The framework at 0.71.2, 0.72.0, 0.73.0 or 0.74.1, with one of three sets of packages."""
    k = F.col("s_suppkey")
    core = F.get(F.array(*map(F.lit, ("^0.71.2", "0.72.0", "~0.73.0", ">=0.74.1-rc.2"))), (k % 4).cast("int"))
    dep = lambda n, v: F.struct(F.lit(n).alias("name"), (v if not isinstance(v, str) else F.lit(v)).alias("version"))
    sets = F.when(k % 3 == 0, F.array(dep("@react-native-community/async-storage", "1.0.0"), dep("@react-navigation/native", "^6.1.0"))).when(k % 3 == 1, F.array(dep("@react-navigation/native", "^5.9.8"), dep("react-native-gesture-handler", "~1.10.3"))).otherwise(F.array(dep("react-native-reanimated", "2.0.0-rc.1"), dep("react-native-maps", "latest")))
    d = table(spark, sf_dir, "supplier").select(F.concat(F.lit("app"), k).alias("root"), F.explode(F.concat(F.array(dep("react-native", core)), sets)).alias("d")).select("root", "d.name", "d.version")
    return mobilerules.dependency_rules(d)


@_register("SELECT rule_id, concat('src/v', s_suppkey, '.tsx') AS path, severity, line_start FROM supplier, (VALUES ('framework.react-native.deprecated-api', 'HIGH', 2), ('framework.react-native.flatlist-missing-key', 'LOW', 4)) t(rule_id, severity, line_start) WHERE s_suppkey % 2 = 0 OR line_start = 2")
def mobile_source_findings(spark, sf_dir):
    key = F.when(F.col("s_suppkey") % 2 == 1, " keyExtractor={k}").otherwise("")
    body = F.concat(F.lit("import { View } from 'react-native';\nconst a = ViewPagerAndroid;\n// CheckBox\nreturn <FlatList data={d}"), key, F.lit(" />;\n"))
    return mobilerules.source_rules(table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/v"), "s_suppkey", F.lit(".tsx")).alias("path"), body.alias("content")))


@_register("SELECT concat('e', s_suppkey, '/', CASE s_suppkey % 3 WHEN 0 THEN '.env' WHEN 1 THEN '.env.production' ELSE '.env.staging' END) AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def env_file_findings(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, ".env").when(k % 3 == 1, ".env.production").otherwise(".env.staging")
    body = F.when(k % 2 == 0, "# own\nAPI_TOKEN=Zx81kQp0Lm27Vt\n").otherwise("# own\nNEXT_PUBLIC_TOKEN=Zx81kQp0Lm27Vt\nDEBUG=1\nSECRET=changeme\n")
    return security.env_files(table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), k, F.lit("/"), name).alias("path"), body.alias("content")))


@_register("SELECT 'architecture.barrel-file-risk' AS rule_id, concat('p', s_suppkey, '/index.ts') AS path, CASE WHEN s_suppkey % 20 >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 1 AS line_start FROM supplier WHERE s_suppkey % 20 >= 8")
def barrel_findings(spark, sf_dir):
    body = F.repeat(F.lit("export { a } from './a';\n"), (F.col("s_suppkey") % 20).cast("int"))
    return textrules.barrels(table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey", F.lit("/index.ts")).alias("path"), body.alias("content")))
