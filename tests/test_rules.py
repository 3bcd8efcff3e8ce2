"""Secrets, tests, behaviour and decisions on small inputs."""

from pyspark.sql import functions as F

from auditflow.operators import behavior, decisions, security, testing


def test_secret_lines(spark):
    rows = [
        ("a.py", 'API_KEY = "sk_live_9fQ2xLmZ7Rt"'), ("b.py", 'token = os.environ["TOKEN"]'), ("c.py", "password: changeme"), ("d.py", 'secret = "user-session-backup-vault"'),
        ("e.py", 'url = "https://x.io/f?token=abcdef123456"'), ("f.py", "password=aaaaaaaaaaaa"), ("g.py", "secret = GITHUB_TOKEN"), ("h.py", "token=Zq8vR2mXk01Lw"),
    ]
    got = {r.path: r.confidence for r in security.secret_lines(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {"a.py": "HIGH", "d.py": "LOW", "h.py": "HIGH"}


def test_env_files(spark):
    rows = [(".env", "A=1"), ("x/.env.production", "PORT=80"), ("y/.env.production", "# c\nAPI_KEY=Zq8vR2mXk01LwAb"), ("z/.env.staging", "NEXT_PUBLIC_API_KEY=Zq8vR2mXk01LwAb"), ("env.py", "")]
    got = {r.path: r.confidence for r in security.env_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {".env": "MEDIUM", "y/.env.production": "HIGH"}


def test_tests_and_subjects(spark):
    names = ["src/a.ts", "src/a.test.ts", "src/b.py", "src/tests/test_b.py", "src/c.go", "src/d.rs", "src/d_tests.rs", "src/e.py"]
    files = spark.createDataFrame([(n, "production" if "test" not in n else "test", n == "src/e.py") for n in names], "path string, role string, has_inline_tests boolean")
    assert {tuple(r) for r in testing.subjects(files).select("test", "subject").collect()} == {("src/a.test.ts", "src/a.ts"), ("src/tests/test_b.py", "src/b.py"), ("src/d_tests.rs", "src/d.rs")}
    assert [r.path for r in testing.without_test(files).collect()] == ["src/c.go"]
    assert not testing.missing_test_folder(files).first().missing and testing.missing_test_folder(files.filter("path LIKE '%.rs'")).first().missing
    inside = spark.createDataFrame([("a.rs", "Rust", "#[cfg(test)]\nmod t {}"), ("b.rs", "Rust", "fn f() {}"), ("c", None, None)], "path string, language string, content string")
    assert [r.has_inline_tests for r in testing.with_inline_tests(inside).orderBy("path").collect()] == [True, False, False]


def test_behavior(spark):
    lines = [("a.py", "added", 1, "import requests"), ("a.py", "added", 2, "requests.get(u)"), ("a.py", "added", 3, "subprocess.run(x)"), ("a.py", "removed", 1, "os.system(x)"), ("tests/test_a.py", "added", 1, "os.system(x)"), ("b.ts", "added", 9, "import x from '@own/lib/y'"), ("b.ts", "added", 10, "import y from './z'"), ("db/migrations/1.py", "added", 1, "x = 1"), ("c.go", "added", 4, '  q := "SELECT a FROM t"')]
    own = spark.createDataFrame([("@own/lib",)], "name string")
    got = {tuple(r) for r in behavior.added(spark.createDataFrame(lines, "path string, side string, line int, text string"), own).collect()}
    assert got == {("a.py", "dependency-import-added", 1), ("a.py", "network-call-added", 2), ("a.py", "subprocess-added", 3), ("db/migrations/1.py", "migration-added", 1), ("c.go", "raw-sql-added", 4)}
    before = spark.createDataFrame([("a.py", "try:\n x\nexcept E:\n y"), ("b.py", "@login_required\ndef f(): pass"), ("tests/t.py", "x"), ("c.py", "try: x")], "path string, content string")
    after = spark.createDataFrame([("a.py", "x"), ("b.py", "def f(): pass"), ("c.py", "try: y")], "path string, content string")
    assert {tuple(r) for r in behavior.removed(before, after).collect()} == {("a.py", "error-handling-removed"), ("b.py", "auth-check-removed"), ("tests/t.py", "test-deleted-or-emptied")}


def test_decisions(spark):
    f = spark.createDataFrame([(1, "r", "src/a.rs", "Rust", "production", "HIGH"), (2, "r", "tests/a.rs", "Rust", "test", "HIGH"), (3, "r", "gen/a.rs", "Rust", "generated", "HIGH"), (4, "r", "a.py", "Python", "production", "HIGH"), (5, "q", "src/b", None, None, "LOW"), (6, "q", "old/b", None, None, "LOW")], "finding_no long, rule_id string, path string, language string, role string, severity string")
    gates = spark.createDataFrame([("r", ["Rust"])], "rule_id string, languages array<string>")
    over = spark.createDataFrame([(1, "r", "test", "LOW", "tests"), (2, "r", "generated", None, "generated"), (3, "r", "generated", "CRITICAL", "too late")], "ord int, rule_id string, role string, severity string, reason string")
    overlay = spark.createDataFrame([(1, "q", "^src/", "HIGH", "2999-01-01", "ours"), (2, "q", "^old/", None, "2000-01-01", "expired")], "ord int, rule_id string, pattern string, severity string, expires string, reason string")
    got = {r.finding_no: (r.severity, r.action, r.reason) for r in decisions.decided(f, gates, over, overlay, F.current_date()).collect()}
    assert got == {1: ("HIGH", "keep", None), 2: ("LOW", "lower", "tests"), 3: ("HIGH", "suppress", "generated"), 4: ("HIGH", "not-applicable", None), 5: ("HIGH", "raise", "ours"), 6: ("LOW", "keep", None)}
