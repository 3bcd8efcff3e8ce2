"""Queries on what files are: frameworks, runtimes, paradigms, boundaries, mobile platforms, and orders of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pyspark.sql.window import Window

from ..functions import classes
from ..operators import boundaries, findings as fo, mobilerules, risk, visibility
from ..sources import syntax
from . import relations as rel
from .catalog import _RISKY, _SEV, _register, _visibility_sql
from .module_catalog import _pick
from .storage import table

#: Files by what they are: path ({k}: the customer), language, text, frameworks, runtimes, paradigms.
CONTEXTS = (
    ("src/App{k}.tsx", "TypeScript", "import { View } from 'react-native';\nimport 'expo-router';\nexport default () => null;\n", "react-native expo react", "react-native", "declarative-ui functional mixed"),
    ("web/pages/p{k}.jsx", "JavaScript", "export class P {}\n", "react next", "browser", "declarative-ui functional object-oriented mixed"),
    ("src/useThing{k}.ts", "TypeScript", "import { useState } from 'react';\n", "react", "browser", "functional reactive mixed"),
    ("srv/s{k}.js", "JavaScript", "const app = express();\napp.get('/', (q) => process.exit(1));\n", "express node", "node", "functional"),
    ("srv/n{k}.ts", "TypeScript", "import { Module } from '@nestjs/common';\nimport fs from 'node:fs';\nclass M {}\n", "nest node", "node", "object-oriented"),
    ("lib/v{k}.ts", "TypeScript", "import x from '@vue/y';\nconst a = 1;\n", "vue", "browser", "unknown"),
    ("core/src/main.rs", "Rust", "struct A;\nfn main() { x.map(f); }\n", "", "rust-cli", "functional object-oriented procedural mixed"),
    ("core/src/c{k}.rs", "Rust", "fn a() {}\n", "", "rust-library", "unknown"),
    ("app/d{k}.py", "Python", "from django.db import models\n", "django", "python", "unknown"),
    ("cmd/e{k}.go", "Go", "import \"github.com/gin-gonic/gin\"\nfunc main() {}\n", "gin", "go", "procedural"),
    ("j/F{k}.java", "Java", "import org.springframework.boot.A;\npublic class F {}\n", "spring", "jvm", "object-oriented"),
    ("android/G{k}.kt", "Kotlin", "fun g() {}\n", "android", "jvm android", "unknown"),
    ("Assets/H{k}.cs", "C#", "using UnityEngine;\nclass H : MonoBehaviour {}\n", "unity", "unity", "object-oriented data-oriented mixed"),
    ("api/Controllers/I{k}.cs", "C#", "interface I {}\n", "dotnet", "dotnet", "object-oriented"),
    ("ops/k{k}.yaml", "YAML", "apiVersion: v1\nkind: Service\n", "", "infrastructure", "declarative"),
    ("ops/l{k}.tf", "Terraform", "", "", "infrastructure", "unknown"),
    ("bin/m{k}.sh", "Shell", "echo\n", "", "shell", "unknown"),
    ("src/n{k}.cpp", "C++", None, "", "native", "unknown"),
    ("doc/o{k}.xyz", None, None, "", "unknown", "unknown"),
)
_lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
_ROWS = ", ".join(f"({i}, {_lit(p)}, {_lit(f)}, {_lit(r)}, {_lit(d)})" for i, (p, _, _, f, r, d) in enumerate(CONTEXTS))


def _contexts(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda i: _pick([c[i] for c in CONTEXTS], k % len(CONTEXTS))
    return table(spark, sf_dir, "customer").select("c_custkey", F.replace(part(0), F.lit("{k}"), k.cast("string")).alias("path"), part(1).alias("language"), part(2).alias("content"))


@_register(f"SELECT c_custkey, replace(path, '{{k}}', CAST(c_custkey AS VARCHAR)) AS path, frameworks, runtimes, paradigms FROM customer JOIN (VALUES {_ROWS}) t(no, path, frameworks, runtimes, paradigms) ON c_custkey % {len(CONTEXTS)} = no")
def file_contexts(spark, sf_dir):
    of = lambda f: F.array_join(f(F.col("path"), F.col("content"), F.col("language")), " ")
    return _contexts(spark, sf_dir).select("c_custkey", "path", of(classes.frameworks).alias("frameworks"), of(classes.runtimes).alias("runtimes"), of(classes.paradigms).alias("paradigms"))


#: Files by what they decide: path, language, text, class, and what tells it.
DECIDERS = (
    ("src/login/u{k}.ts", "TypeScript", "import cors from 'cors';\n", "access-control", "path"), ("src/a{k}.ts", "TypeScript", "import cors from 'cors';\nimport jwt from 'jsonwebtoken';\n", "request-trust", "content"),
    ("src/b{k}.ts", "TypeScript", "import { author } from './authors';\nconst s = 'import passport';\n// import passport from 'passport'\n", None, None), ("src/c{k}.py", "Python", "import os\n\n@login_required\ndef f():\n    pass\n", "access-control", "content"),
    ("src/d{k}.py", "Python", "from flask_login import current_user\n", "access-control", "content"), ("src/E{k}.java", "Java", "class E {\n  @RolesAllowed(\"x\")\n  void f() { }\n}\n", "access-control", "content"),
    ("src/f{k}.rs", "Rust", "use argon2::Hash;\nfn a() {}\n", "access-control", "content"), ("src/G{k}.cs", "C#", "class G {\n  [Authorize]\n  public void F(int a) { }\n}\n", "access-control", "content"), ("src/h{k}.go", "Go", "package h\n\nimport (\n\t\"fmt\"\n\t\"github.com/casbin/casbin\"\n)\n", "access-control", "content"),
    ("src/i{k}.py", "Python", "import cryptography\nimport helmet\n", "access-control", "content"), ("ops/j{k}.tf", None, None, "deploy-surface", "path"),
)
_DECIDERS = ", ".join(f"({i}, {_lit(p)}, {_lit(b)}, {_lit(by)})" for i, (p, _, _, b, by) in enumerate(DECIDERS) if b)


@_register(f"SELECT replace(path, '{{k}}', CAST(c_custkey AS VARCHAR)) AS path, boundary, by_ AS by FROM customer JOIN (VALUES {_DECIDERS}) t(no, path, boundary, by_) ON c_custkey % {len(DECIDERS)} = no")
def boundary_of_contents(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda i: _pick([c[i] for c in DECIDERS], k % len(DECIDERS))
    f = table(spark, sf_dir, "customer").select(F.replace(part(0), F.lit("{k}"), k.cast("string")).alias("path"), part(1).alias("language"), part(2).alias("content"))
    return boundaries.classed(f, syntax.nodes(f, boundaries.KINDS))


# ---- mobile platforms -----------------------------------------------------------------------

_SWITCH = {"android_new_arch": "s_suppkey % 3", "ios_new_arch": "s_suppkey // 3 % 3", "expo_new_arch": "s_suppkey // 9 % 2 + 1"}
_ON = {n: f"CASE {e} WHEN 0 THEN true WHEN 1 THEN false END" if n != "expo_new_arch" else f"CASE {e} WHEN 1 THEN true END" for n, e in _SWITCH.items()}
_PROFILES = f"profiles AS (SELECT s_suppkey AS k, s_suppkey % 10 <> 9 AS detected, {', '.join(f'{e} AS {n}' for n, e in _ON.items())}, s_suppkey % 4 = 0 AS off_pods, s_suppkey % 5 = 0 AS off_gradle, s_suppkey % 7 = 0 AS codegen FROM supplier), judged AS (SELECT *, coalesce(android_new_arch, false) OR coalesce(ios_new_arch, false) OR coalesce(expo_new_arch, false) AS any_on, NOT coalesce(android_new_arch, true) OR NOT coalesce(ios_new_arch, true) AS any_off FROM profiles WHERE detected)"
_P = "'framework.react-native."


@_register(
    f"SELECT rule_id, path, severity, 1 AS line_start FROM (SELECT k, {_P}old-architecture' AS rule_id, 'package.json' AS path, 'MEDIUM' AS severity FROM judged WHERE NOT (any_on AND NOT any_off) UNION ALL SELECT k, {_P}architecture-mismatch', 'package.json', 'HIGH' FROM judged WHERE any_on AND any_off"
    f" UNION ALL SELECT k, {_P}hermes-mismatch', 'package.json', 'MEDIUM' FROM judged WHERE off_pods <> off_gradle UNION ALL SELECT k, {_P}hermes-disabled', 'ios/Podfile', 'LOW' FROM judged WHERE off_pods UNION ALL SELECT k, {_P}hermes-disabled', 'android/gradle.properties', 'LOW' FROM judged WHERE off_gradle"
    f" UNION ALL SELECT k, {_P}codegen-missing', 'package.json', 'MEDIUM' FROM judged WHERE any_on AND NOT codegen)",
    also=_PROFILES,
)
def mobile_platform_findings(spark, sf_dir):
    """Projects with every mixture of switches; their sources need generated code."""
    k = F.col("s_suppkey")
    on = {n: F.expr(e.replace("//", "div")) for n, e in _ON.items()}
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 10 != 9).alias("detected"), *(e.alias(n) for n, e in on.items()), (k % 7 == 0).alias("has_codegen"), (k % 4 == 0).alias("off_pods"), (k % 5 == 0).alias("off_gradle"))
    some = lambda v: F.greatest(*(F.coalesce((F.col(n) == v).cast("int"), F.lit(0)) for n in on)) == 1
    p = p.withColumns({"arch_mismatch": some(True) & some(False), "hermes_mismatch": F.col("off_pods") != F.col("off_gradle"), "podfile": F.when(F.col("off_pods"), "  :hermes_enabled => false\n").otherwise("target 'x'\n"), "gradle": F.when(F.col("off_gradle"), "a=1\nhermesEnabled=false\n").otherwise("# hermesEnabled=false\n")})
    sources = spark.createDataFrame([("JavaScript", "export default codegenNativeComponent('X');")], "language string, content string")
    need = mobilerules.codegen_used(sources)  # one row
    return mobilerules.profile_rules(p.crossJoin(F.broadcast(need)), F.col("used"))


# ---- orders, told by each row's place -------------------------------------------------------

_CATEGORY = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fo.CATEGORIES)) + f" ELSE {len(fo.CATEGORIES)} END"


@_register("SELECT intent, rule_id, category, reason, n, row_number() OVER (ORDER BY n DESC, intent, rule_id, reason, category) AS place FROM (SELECT intent, rule_id, category, reason, count(*) AS n FROM shown WHERE NOT visible GROUP BY ALL)", "findings", also=_visibility_sql())
def hidden_places(spark, sf_dir):
    f = visibility.hidden_summary(visibility.classified(risk.base_score(rel.findings(spark, sf_dir)).withColumn("has_evidence", F.lit(True))))
    return f.withColumn("place", F.row_number().over(Window.orderBy(*visibility.hidden_order(), "category")))  # a row a rule


@_register(f"SELECT finding_no, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, {_SEV} DESC, {_CATEGORY}, concat(path, ':', line_start), finding_no) AS place FROM risky", "findings", also=_RISKY)
def finding_places(spark, sf_dir):
    """Each finding's place among those of its rule."""
    w = Window.partitionBy("rule_id").orderBy(*fo.canonical_order(), "finding_no")
    return risk.base_score(rel.findings(spark, sf_dir)).select("finding_no", F.row_number().over(w).alias("place"))
