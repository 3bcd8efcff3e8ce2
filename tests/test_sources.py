"""Trees, diffs, manifests, imports, reports and incremental runs on small inputs."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from auditflow.operators import review, risk
from auditflow.sinks import reports
from auditflow.sources import gitdiff, imports, manifests, repository
from auditflow.streaming import incremental

TREE = {
    "a.py": "import pkg.b\nfrom . import c\ntry:\n    import missing\nexcept ImportError:\n    pass\n\ndef f():\n    import c\n",
    "c.py": "from pkg import nothing\n", "pkg/__init__.py": "", "pkg/b.py": "if x and y:\n    pass\n", ".env": "A=1\n", ".github/w.yml": "x: 1\n", "node_modules/m/x.js": "1", "skip.log": "x", "__tests__/b.py": "x = 1\n",
    "web/app.ts": "import { x } from './lib/util'\nexport * from \"./gone\"\nconst y = import('./lazy')\n", "web/lib/util.ts": "export const x = 1\n", "web/lazy/index.tsx": "export {}\n",
    "core/src/lib.rs": "mod net;\nuse crate::net::Client;\n", "core/src/net.rs": "use super::net;\n", ".gitignore": "*.log\n# no\n",
    "package.json": json.dumps({"workspaces": ["web"], "dependencies": {"react": "18.0.0"}}), "web/package.json": json.dumps({"name": "@x/web"}), "requirements.txt": "Django==4.2\nrequests\n",
    "CODEOWNERS": "# owners\n* @all\n/pkg/ @pkg @ops\n*.ts @web\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_text(text)
    (top / "bin.dat").write_bytes(b"\xff\xfe\x00")
    (top / "big.py").write_text("x = 1\n" * 100)
    return str(top)


def test_walk(root):
    found = repository.walk(root)
    assert {".env", "pkg/__init__.py", "__tests__/b.py"} <= set(found)
    assert not any(p.startswith(("node_modules", ".github")) or p.endswith(".log") for p in found)
    assert found == sorted(found, key=lambda p: p.split("/")) and repository.walk(root, max_files=2) == found[:2]
    assert repository.ignore_patterns("dist") == ["dist", "**/dist", "dist/**", "**/dist/**"] and repository.ignore_patterns("a/b/") == ["a/b", "a/b/**"]


def test_load(spark, root):
    rows = {r.path: r for r in repository.load(spark, root, max_bytes=500).collect()}
    assert rows["big.py"].skip_reason == "large-file" and rows["bin.dat"].skip_reason == "binary" and rows["__tests__/b.py"].skip_reason == "low-signal"
    assert rows["pkg/b.py"].skip_reason is None and (rows["pkg/b.py"].non_empty_lines, rows["pkg/b.py"].branches, rows["pkg/b.py"].language) == (2, 1, "Python")


def test_imports(spark, root):
    files = repository.load(spark, root)
    found = imports.resolved(imports.imports(files), files).cache()
    edges = {(r.src, r.dst, r.deferred) for r in imports.edges(found).collect()}
    assert edges == {("a.py", "pkg/b.py", False), ("a.py", "c.py", False), ("c.py", "pkg/__init__.py", False), ("web/app.ts", "web/lib/util.ts", False), ("web/app.ts", "web/lazy/index.tsx", True), ("core/src/lib.rs", "core/src/net.rs", False)}
    assert [(r.src, r.spec) for r in imports.unresolved(found.filter("src LIKE 'web/%'")).collect()] == [("web/app.ts", "./gone")]
    assert found.filter("spec = 'missing'").first().guarded


def test_manifests(spark, root):
    assert manifests.packages(root) == [("@x/web", "web", True)]
    assert set(manifests.frameworks(root)) == {("React", "18.0.0"), ("Django", "4.2")}
    files = spark.createDataFrame([(p,) for p in ("a.py", "pkg/b.py", "web/app.ts", "web/pkg/x.py")], "path string")
    owned = review.owners(files, manifests.owners(spark, root))
    assert {r.path: r.owners for r in owned.collect()} == {"a.py": ["@all"], "pkg/b.py": ["@pkg", "@ops"], "web/app.ts": ["@web"], "web/pkg/x.py": ["@all"]}
    assert tuple(review.ownership_summary(owned).first()) == (["@all", "@ops", "@pkg", "@web"], 0)
    ok = manifests.feedback(spark, [{"rule_id": "r", "path": "a"}, {"rule_id": "r", "kind": "k"}, {"kind": "k", "expires": "soon"}, {"kind": "k", "expires": "2020-01-01"}])
    assert ok.count() == 2 and ok.filter(review.expired(F.col("expires"), F.current_date())).count() == 1


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -3,2 +3 @@ def f():
-old
--- looks like a header
+++ new
@@ -9,0 +10,2 @@
+a
+b
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.py b/q.py
similarity index 100%
rename from p.py
rename to q.py
"""


def test_diff(spark):
    files, ranges, lines = gitdiff.changes(spark, DIFF)
    assert [tuple(r) for r in files.collect()] == [("x.py", "modified"), ("gone.py", "deleted"), ("q.py", "renamed")]
    assert [tuple(r) for r in ranges.collect()] == [("x.py", 3, 3), ("x.py", 10, 11)]
    assert ("x.py", "removed", 4, "-- looks like a header") in {tuple(r) for r in lines.collect()} and ("x.py", "added", 3, "++ new") in {tuple(r) for r in lines.collect()}


def test_git(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("1\n3\n")
    (tmp_path / "new.py").write_text("x\n")
    got = {f["path"]: (f["status"], f["hunks"][0]["new"]) for f in gitdiff.parse_diff(gitdiff.diff_of(str(tmp_path)))}
    assert got == {"a.py": ("modified", (2, 2)), "new.py": ("added", (1, 1))}
    assert gitdiff.blob(str(tmp_path), "HEAD", "a.py") == "1\n2\n" and gitdiff.blob(str(tmp_path), "HEAD", "no") is None


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(1, "security.secret-candidate", "SECURITY", "HIGH", "HIGH", "b.py", 3, "Secret | here"), (2, "code-marker.todo", "CODE_QUALITY", "LOW", "LOW", "a.py", 1, "Todo")]
    return risk.base_score(spark.createDataFrame(rows, "finding_no long, rule_id string, category string, severity string, confidence string, path string, line_start int, title string"))


def test_reports(spark, findings):
    sarif = json.loads(reports.to_sarif(findings))
    results = sarif["runs"][0]["results"]
    assert sarif["version"] == "2.1.0" and [r["level"] for r in results] == ["error", "note"] and results[0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "b.py"}, "region": {"startLine": 3}}
    assert [f["finding_no"] for f in json.loads(reports.to_json(findings))["findings"]] == [1, 2]
    assert "| P0 | 95 | HIGH | security.secret-candidate | b.py:3 |" in reports.to_markdown(findings)
    keyed = findings.withColumn("key", F.concat_ws(":", "rule_id", "path"))
    assert [r.key for r in reports.baseline(keyed).collect()] == ["code-marker.todo:a.py", "security.secret-candidate:b.py"]
    assert reports.within_budget(findings.withColumn("cost", F.lit(40)), "cost", 100).count() == 2
    assert reports.within_budget(findings.withColumn("cost", F.lit(60)), "cost", 100).count() == 0


def test_baseline_and_history_files(spark, tmp_path):
    b = tmp_path / "baseline.json"
    b.write_text(json.dumps({"schema_version": 1, "findings": [{"key": "k", "rule_id": "r", "severity": "HIGH", "path": "p", "message": "m"}]}, indent=1))
    assert tuple(manifests.baseline(spark, f"file://{b}").first()) == ("k", "r", "HIGH", "p", "m")
    h = tmp_path / "runs.jsonl"
    h.write_text('{"schema_version": 1, "revision": "a"}\nnot json\n{"schema_version": 1, "revision": "b"}\n')
    assert [r.revision for r in manifests.history(spark, f"file://{h}").orderBy("revision").collect()] == ["a", "b"]


def test_incremental(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path string, content string")
    first = incremental.decisions(files, spark.createDataFrame([], "path string, hash string, config string"), "v1")
    assert {r.miss for r in first.collect()} == {"new-file"}
    cache = first.select("path", "hash", F.lit("v1").alias("config"))
    now = spark.createDataFrame([("a", "1"), ("b", "two"), ("d", None)], "path string, content string")
    assert {r.path: r.miss for r in incremental.decisions(now, cache, "v1").collect()} == {"a": None, "b": "content-changed", "d": None}
    assert {r.miss for r in incremental.decisions(files, cache, "v2").collect()} == {"config-changed"}
    gone = incremental.removed(now, cache)
    fresh = incremental.decisions(now, cache, "v1").filter("miss IS NOT NULL").select("path", "hash", F.lit("v1").alias("config"))
    assert sorted(r.path for r in incremental.refreshed(cache, fresh, gone).collect()) == ["a", "b", "d"]


def test_stream(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    spark.createDataFrame([("a.py", "x // TODO"), ("b.py", "y")], "path string, content string").write.parquet(feed)
    stream = spark.readStream.schema("path string, content string").parquet(feed)
    from auditflow.operators import textrules

    incremental.follow(stream, textrules.markers, out, str(tmp_path / "state")).awaitTermination(60)
    assert [r.path for r in spark.read.parquet(out).collect()] == ["a.py"]
