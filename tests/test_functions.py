"""Path, text and key functions on single values."""

import math

import pytest
from pyspark.sql import functions as F

from auditflow.functions import keys, paths, text
from auditflow.operators import review, textrules


def one(spark, column, *values):
    """column(F.col("x")) of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.withColumn("y", column(F.col("x"))).orderBy("i").collect()]


def test_paths(spark):
    assert one(spark, paths.clean, "./a//b", "a\\b", "./", "././x") == ["a/b", "a/b", ".", "x"]
    assert one(spark, paths.normalised, "a/./b/../c", "../x", "a/b") == ["a/c", "x", "a/b"]
    assert one(spark, lambda c: paths.relative(c, "/repo"), "/repo/src/a.py", "/repo", "/other/a") == ["src/a.py", ".", "/other/a"]
    assert one(spark, paths.cluster_scope, "a/b/c.rs", "a/b.rs", "a.rs", "") == ["a/b", "a", "a.rs", "."]
    assert one(spark, paths.low_signal, "src/tests/a.py", "src/test_edges.rs", "src/a_tests.rs", "src/a.test.ts", "src/latest/a.ts", "test_x.py") == [True, False, True, True, False, True]
    assert one(spark, paths.role, "package.json", "build/x.js", "a/fixtures/x.py", "docs/x.md", "a/b_test.go", "src/a.py") == ["config", "generated", "fixture", "documentation", "test", "production"]
    assert one(spark, paths.parent, "a/b/c", "c") == ["a/b", ""]
    assert one(spark, paths.extension, "a/b.ts", "Makefile", ".env") == ["ts", None, None]
    assert one(spark, lambda c: F.array_join(F.array_sort(paths.tokens(c)), ","), "src/authMiddleware.ts") == ["auth,middleware,src,ts"]
    rows = [r.x for r in spark.createDataFrame([("a-b",), ("a/b",), ("a.b",)], "x string").orderBy(paths.ordered(F.col("x"))).collect()]
    assert rows[0] == "a/b"


def test_lines(spark):
    assert one(spark, text.non_empty_lines, "a\n\n \t\nb\r\n", "", None, "　\nx") == [2, 0, 0, 1]
    assert one(spark, text.branches, "if a && b || c\n// if x\nelif y\nnotif z\n  # for x\nfor x in y", "") == [5, 0]
    marked = ["x = 1 // TODO later", "# HACK FIXME", "TODO without comment", "a /* HACK */", "s = 'x' -- TODO"]
    assert one(spark, text.marker, *marked) == ["TODO", "FIXME", None, "HACK", "TODO"]
    e = one(spark, text.entropy, "aaaa", "ab", "", "abcd")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(e, [0, 1, 0, 2]))
    assert one(spark, text.key_header, "  -----BEGIN RSA PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----") == [True, False]


def test_keys(spark):
    k = lambda x: keys.stable_key(F.lit("r"), F.lit("a.py"), F.lit("T"), F.lit("D"), x)
    a = one(spark, k, 'key = "one" + 12', 'KEY  = "two" + 7', "key = x + 1", " ")
    assert a[0] == a[1] != a[2] != a[3] and a[0].startswith("r:a.py:") and len(a[0].split(":")[2]) == 16


def test_boundaries(spark):
    got = one(spark, review.boundary, ".github/workflows/auth.yml", "web/package.json", "a/.env.local", "src/corsSetup.ts", "src/userLogin.ts", "src/authors.ts", "infra/main.tf", "x/oauth2.py")
    assert got == ["deploy-surface", "supply-chain", "secret-config", "request-trust", "access-control", None, "deploy-surface", "access-control"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("src/a.rs", "Rust", "fn f() {\n  x.unwrap();\n  // y.unwrap()\n}"),
        ("src/b.ts", "TypeScript", "var a = 1\nconsole.log(a)\nimport x from '../../../y'\n// TODO z"),
        ("app/settings.py", "Python", "DEBUG = True\nALLOWED_HOSTS = []\ntry:\n  pass\nexcept:\n  pass"),
        ("app/other.py", "Python", "DEBUG = True"),
        ("id_rsa", None, "-----BEGIN OPENSSH PRIVATE KEY-----\nx"),
        ("lib/index.ts", "TypeScript", "\n".join(f"export * from './m{i}'" for i in range(6))),
        ("a/b/c/d/e/f/g.py", "Python", None),
    ]
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_text_rules(files):
    rows = lambda df: sorted((r.rule_id, r.path, r.line_start, r.severity) for r in df.collect())
    assert rows(textrules.line_rules(files)) == [
        ("framework.django.debug-true", "app/settings.py", 1, "HIGH"), ("framework.django.missing-allowed-hosts", "app/settings.py", 2, "HIGH"), ("framework.js.console-log", "src/b.ts", 2, "LOW"),
        ("framework.js.var-declaration", "src/b.ts", 1, "LOW"), ("language.python.exception-risk", "app/settings.py", 5, "MEDIUM"), ("language.rust.panic-risk", "src/a.rs", 2, "MEDIUM"),
    ]
    assert rows(textrules.markers(files)) == [("code-marker.todo", "src/b.ts", 4, "LOW")]
    assert rows(textrules.private_keys(files)) == [("security.private-key-candidate", "id_rsa", 1, "CRITICAL")]
    assert rows(textrules.deep_imports(files)) == [("architecture.deep-relative-imports", "src/b.ts", 3, "LOW")]
    assert rows(textrules.barrels(files)) == [("architecture.barrel-file-risk", "lib/index.ts", 1, "MEDIUM")]
    assert rows(textrules.deep_directories(files)) == [("architecture.deep-directory-nesting", "a/b/c/d/e/f/g.py", 1, "LOW")]
