"""Readers of configuration and projects, rules on them, and reports, on small trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from auditflow.operators import mobilerules, reviewreport
from auditflow.sinks import reports
from auditflow.sources import config, imports, manifests, mobile, repository


def _tree(root, files):
    for path, text in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
    return str(root)


def test_walk_honours_nested_ignores_and_negation(tmp_path):
    files = {".gitignore": "*.log\n!keep.log\n/only-top.txt\nout/\n", "a.log": "", "keep.log": "", "only-top.txt": "", "sub/only-top.txt": "", "sub/.gitignore": "local.*\n!a.log\n", "sub/local.py": "", "sub/a.log": "", "out/x.py": "", "sub/out": "", ".auditflow/x": "", "local.py": ""}
    assert repository.walk(_tree(tmp_path, files)) == [".gitignore", "keep.log", "local.py", "sub/.gitignore", "sub/a.log", "sub/only-top.txt", "sub/out"]


def test_table_source_marks_binary_and_large(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"x = 1\n")), ("b.py", bytearray(b"\xff\xfe")), ("c.py", bytearray(b"x" * 50)), ("tests/d.py", bytearray(b"x"))], "path string, content binary")
    got = {r.path: (r.skip_reason, r.non_empty_lines) for r in repository.from_table(df, max_bytes=40).collect()}
    assert got == {"a.py": (None, 1), "b.py": ("binary", 0), "c.py": ("large-file", 0), "tests/d.py": ("low-signal", 0)}


def test_settings_overlay_and_feedback(spark, tmp_path):
    root = _tree(tmp_path, {
        "auditflow.toml": "max_files = 7\n[rules]\nmax-fan-out = 3\n",
        ".auditflow/overlay.toml": '[[entry]]\nrule = "r1"\npath = "src/**/*.py"\nseverity = "low"\nexpires = 2999-01-01\n[[entry]]\nkind = "taint-sql"\nreason = "ours"\n',
        ".auditflow/feedback.yml": "version: 1\nsuppressions:\n  - rule_id: r1\n    path: 'a.py'  # why\n    expires: 2030-01-31\n  - rule: r2\n    kind: k\n    path: b\n  - kind: k2\n    path: c/**\n    expires: soon\n",
    })
    assert {k: v for k, v in config.settings(f"{root}/auditflow.toml").items() if v != config.DEFAULTS[k]} == {"max_files": 7, "max_fan_out": 3}
    assert config.settings(f"{root}/none.toml") == config.DEFAULTS
    got = [tuple(r) for r in config.overlay(spark, root).orderBy("ord").collect()]
    assert got == [(1, "r1", None, "^src/(?:.*/)?[^/]*\\.py$", "LOW", "2999-01-01", None), (2, None, "taint-sql", None, None, None, "ours")]
    ok, bad = config.feedback(spark, root)
    assert [tuple(r) for r in ok.collect()] == [(1, "r1", None, "a.py", None, "2030-01-31")]
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "needs a rule or a kind, not both"), (3, "'soon' is no YYYY-MM-DD date")]
    with pytest.raises(config.Invalid, match="no rule"):
        config.overlay(spark, root, known_rules=("other",))


def test_knowledge_reports_and_baselines(spark, tmp_path):
    root = _tree(tmp_path, {
        "pack.toml": '[[rule]]\nid = "r1"\nlanguages = ["Rust"]\n[rule.suppress]\nconfig = true\n[[rule.override]]\nrole = "test"\nseverity = "low"\n',
        "ok.json": json.dumps({"schema_version": "0.25", "findings": [{"rule_id": "r", "severity": "high", "title": "t", "evidence": [{"path": "a", "line_start": 3}]}]}), "old.json": json.dumps({"schema_version": "0.2"}),
        "base.json": json.dumps({"schema_version": 2, "findings": []}),
    })
    gates, overrides = config.knowledge(spark, f"{root}/pack.toml")
    assert gates.first().suppress_config and gates.first().languages == ["Rust"] and tuple(overrides.first()) == (0, "r1", "test", "LOW", None)
    assert tuple(config.report(spark, f"{root}/ok.json").first()) == ("r", "a", 3, "HIGH", "t")
    for bad in ("old.json", "none.json"):
        with pytest.raises(config.Invalid):
            config.report(spark, f"{root}/{bad}")
    with pytest.raises(ValueError, match="schema version 2"):
        manifests.baseline(spark, f"{root}/base.json")


def test_mobile_profile_and_its_rules(spark, tmp_path):
    root = _tree(tmp_path, {
        "package.json": json.dumps({"dependencies": {"react-native": "^0.74.1"}}), "yarn.lock": "", "android/gradle.properties": "newArchEnabled=true\nhermesEnabled=false # off\n", "ios/Podfile": "ENV['RCT_NEW_ARCH_ENABLED'] = '0'\n:hermes_enabled => true\n",
    })
    p = mobile.profiles(spark, [root, str(tmp_path / "none")])
    r = p.first()
    assert (r.version, r.kind, r.package_manager, r.android_new_arch, r.ios_new_arch, r.hermes, r.arch_mismatch, r.hermes_mismatch) == ("0.74.1", "bare", "yarn", True, False, None, True, True)
    used = mobilerules.codegen_used(spark.createDataFrame([("TypeScript", "TurboModuleRegistry.get('x')")], "language string, content string")).first().used
    found = {(x.rule_id.rsplit(".", 1)[1], x.severity, x.path) for x in mobilerules.profile_rules(p, F.lit(used)).collect()}
    assert found == {("old-architecture", "MEDIUM", "package.json"), ("architecture-mismatch", "HIGH", "package.json"), ("hermes-mismatch", "MEDIUM", "package.json"), ("hermes-disabled", "LOW", "android/gradle.properties"), ("codegen-missing", "MEDIUM", "package.json")}
    assert {tuple(x) for x in mobile.dependency_table(spark, [root]).collect()} == {(root, "react-native", "^0.74.1")}


def test_projects_of_a_workspace(spark, tmp_path):
    root = _tree(tmp_path, {
        "package.json": json.dumps({"workspaces": ["apps/*"], "dependencies": {"express": "4.1.0"}}), "apps/web/package.json": json.dumps({"name": "web", "dependencies": {"react": "18.0.0"}}), "apps/tool/package.json": json.dumps({"name": "tool", "bin": {"t": "x.js"}}),
    })
    assert {tuple(r) for r in mobile.framework_projects(spark, root).collect()} == {("", "Express", "4.1.0"), ("apps/web", "React", "18.0.0")}
    assert {tuple(r) for r in mobile.executable_roots(spark, root).collect()} == {("", False), ("apps/web", False), ("apps/tool", True)}


def test_imports_by_alias_and_by_directory(spark):
    aliases = imports.tsconfig_aliases('{ // paths\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "lib": ["vendor/lib.ts",]}} }')
    assert aliases == {"@/*": ["src/*"], "lib": ["src/vendor/lib.ts"]}
    rows = [("src/a.ts", "TypeScript", "import x from '@/b/c';\nimport y from 'lib';\nimport z from 'react';"), ("src/b/c.ts", "TypeScript", ""), ("src/vendor/lib.ts", "TypeScript", ""), ("main.go", "Go", 'import "ex.org/m/pkg"\n'), ("pkg/b.go", "Go", ""), ("pkg/a.go", "Go", ""), ("pkg/a_test.go", "Go", "")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    got = {(r.src, r.dst) for r in imports.edges(imports.resolved(imports.imports(files, "ex.org/m", aliases), files)).collect()}
    assert got == {("src/a.ts", "src/b/c.ts"), ("src/a.ts", "src/vendor/lib.ts"), ("main.go", "pkg/a.go")}


def _scored(spark):
    rows = [("r1", "a.py", 3, "HIGH", "HIGH", "SECURITY", "Secret <b>", "d", "x = 1", 90, "P0"), ("r2", "b.py", 1, "LOW", "LOW", "TESTING", "Missing", "d", "", 10, "P3")]
    return spark.createDataFrame(rows, "rule_id string, path string, line_start int, severity string, confidence string, category string, title string, description string, snippet string, score int, priority string")


def test_every_format_of_a_report(spark):
    f = _scored(spark)
    text = {fmt: reports.render(f, fmt) for fmt in reports.FORMATS}
    assert text["console"].splitlines()[0].startswith("P0 HIGH") and "Secret &lt;b&gt;" in text["html"] and "| P0 | 90 |" in text["markdown"]
    marks = [r["partialFingerprints"]["stableKey/v1"] for r in json.loads(text["sarif"])["runs"][0]["results"]]
    assert marks[0].startswith("r1:a.py:") and len(set(marks)) == 2
    moved = reports.to_sarif(f.withColumn("line_start", F.col("line_start") + 5))
    assert marks == [r["partialFingerprints"]["stableKey/v1"] for r in json.loads(moved)["runs"][0]["results"]]
    with pytest.raises(ValueError):
        reports.render(f, "xml")


def test_receipt_and_snapshot_marker(spark, tmp_path):
    files = spark.createDataFrame([("a", "Rust", None, 4), ("b", None, "binary", 0)], "path string, language string, skip_reason string, non_empty_lines long")
    got = reports.receipt(_scored(spark), files, spark.createDataFrame([("x", 2)], "reason string, n long"), {"head": "abc"})
    assert (got["scope"]["files_analyzed"], got["findings"]["high"], got["findings"]["total"], got["languages"], got["hidden"]) == (1, 1, 2, {"Rust": 1}, [{"reason": "x", "n": 2}])
    path = str(tmp_path / "marker.json")
    reports.snapshot_marker(path, "abc", "f", 2)
    with open(path) as f:
        assert json.load(f)["revision"] == "abc"


def test_review_renders(spark):
    findings = _scored(spark).withColumn("in_diff", F.lit(True)).withColumn("finding_no", F.monotonically_increasing_id())
    signals = spark.createDataFrame([("behavioral", "subprocess-added", "a.py", 3, "subprocess added", None, False)], "family string, kind string, path string, line int, headline string, detail string, coarse boolean")
    none = spark.createDataFrame([], "kind string, pattern string, expires string, reason string")
    edges = spark.createDataFrame([("b.py", "a.py")], "src string, dst string")
    tiers = reviewreport.tiered(signals, spark.createDataFrame([], "path string, start int, stop int"))
    from auditflow.operators import review

    s = review.importer_counts(reviewreport.suppressed(tiers, none, none, F.current_date()), edges)
    report = reviewreport.Report(findings, s, edges, spark.createDataFrame([("a.py", ["@a"])], "path string, owners array<string>"), spark.createDataFrame([(False,)], "missing boolean"))
    why = reviewreport.reasons(report)
    assert [(r.code, r.n) for r in why.collect()] == [("priority-p0", 1), ("definitely-sensitive", 1), ("visible-finding", 2)]
    assert "Verdict: blocked" in reviewreport.rendered(report, why) and "importers: 1" in reviewreport.rendered(report, why, "console")
    assert json.loads(reviewreport.rendered(report, why, "json"))["verdict"] == "blocked" and "runs" in json.loads(reviewreport.rendered(report, why, "sarif"))
