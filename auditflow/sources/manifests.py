"""Owners, packages, frameworks, baselines, histories and feedback, read as relations."""

from __future__ import annotations

import glob
import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession, functions as F

OWNER_PLACES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")

#: Manifest dependencies that name a framework.
JS_FRAMEWORKS = {"react-native": "React Native", "next": "Next.js", "react": "React", "vue": "Vue", "@angular/core": "Angular", "svelte": "Svelte", "express": "Express", "@nestjs/core": "NestJS"}
PY_FRAMEWORKS = {"django": "Django", "flask": "Flask", "fastapi": "FastAPI"}
GO_FRAMEWORKS = {"github.com/gin-gonic/gin": "Gin", "github.com/labstack/echo": "Echo", "github.com/gofiber/fiber": "Fiber"}


def _read(*parts: str) -> str | None:
    try:
        with open(os.path.join(*parts), encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def owner_pattern(glob_: str) -> str:
    """The regular expression of a CODEOWNERS pattern."""
    anchored, folder = "/" in glob_.rstrip("/"), glob_.endswith("/")
    body = "".join("(?:.*/)?" if t == "**/" else ".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob_.strip("/")))
    return ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")


def owner_rules(text: str) -> list[tuple[int, str, list[str]]]:
    """(rule_no, pattern, owners) of each line, comments and blank lines aside."""
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        parts = line.split("#")[0].split()
        if parts:
            out.append((i, owner_pattern(parts[0]), parts[1:]))
    return out


def owners(spark: SparkSession, root: str) -> DataFrame:
    found = next((t for p in OWNER_PLACES if (t := _read(root, p)) is not None), "")
    return spark.createDataFrame(owner_rules(found), "rule_no int, pattern string, owners array<string>")


def packages(root: str) -> list[tuple[str, str, bool]]:
    """(name, root, open exports) of workspace packages: npm, pnpm, Cargo, Go."""
    out = []

    def members(patterns, manifest, name_of):
        for p in patterns:
            for d in sorted(glob.glob(os.path.join(root, p))):
                if (t := _read(d, manifest)) is not None:
                    rel = os.path.relpath(d, root).replace(os.sep, "/")
                    out.append((*name_of(t, rel)[:1], rel, name_of(t, rel)[1]))

    def npm(t, rel):
        data = json.loads(t)
        return data.get("name") or rel, any("*" in k for k in data["exports"]) if isinstance(data.get("exports"), dict) else "exports" not in data

    if t := _read(root, "package.json"):
        w = json.loads(t).get("workspaces", [])
        members(w.get("packages", []) if isinstance(w, dict) else w, "package.json", npm)
    if t := _read(root, "pnpm-workspace.yaml"):
        members(re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", t, re.M), "package.json", npm)
    if t := _read(root, "Cargo.toml"):
        members(tomllib.loads(t).get("workspace", {}).get("members", []), "Cargo.toml", lambda t, rel: (tomllib.loads(t).get("package", {}).get("name") or rel, False))
    if t := _read(root, "go.work"):
        uses = re.findall(r"^\s*(?:use\s+)?(\./[^\s()]+)\s*$", t, re.M)
        members(uses, "go.mod", lambda t, rel: ((re.findall(r"^module\s+(\S+)", t, re.M) or [rel])[0], False))
    return list(dict.fromkeys(out))


def frameworks(root: str) -> list[tuple[str, str | None]]:
    """(framework, version) that the manifests of a project name."""
    out = []
    if t := _read(root, "package.json"):
        data = json.loads(t)
        deps = {**data.get("devDependencies", {}), **data.get("dependencies", {})}
        out += [(n, deps[d]) for d, n in JS_FRAMEWORKS.items() if d in deps]
    wanted = (_read(root, "requirements.txt") or "") + "\n" + "\n".join(re.findall(r"[\"']([A-Za-z][\w.-]*(?:[<>=~!]=?[^\"']*)?)[\"']", _read(root, "pyproject.toml") or ""))
    for line in wanted.splitlines():
        if (m := re.match(r"\s*([A-Za-z][\w.-]*)\s*(?:==\s*([\w.]+))?", line)) and m[1].lower() in PY_FRAMEWORKS:
            out.append((PY_FRAMEWORKS[m[1].lower()], m[2]))
    for path, version in re.findall(r"^\s*(?:require\s+)?(\S+/\S+)\s+v(\S+)", _read(root, "go.mod") or "", re.M):
        out += [(n, version) for p, n in GO_FRAMEWORKS.items() if path == p or path.startswith(p + "/")]
    return list(dict.fromkeys(out))


BASELINE = "schema_version int, tool string, created_at string, root string, findings array<struct<key string, rule_id string, severity string, path string, message string>>"
RECEIPT = "schema_version int, recorded_at string, revision string, comparison struct<workspace string, analysis_target string, scope string, base_revision string, head_revision string, profile string, config_fingerprint string, selection_fingerprint string, overlay_fingerprint string, analysis_schema string>, findings array<struct<baseline_id string, occurrence_key string, rule_id string, severity string, path string>>"


#: Fixed value: the schema version of baselines.
BASELINE_VERSION = 1


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(key, rule_id, severity, path, message) of a baseline file; another version is an error."""
    df = spark.read.schema(BASELINE).option("mode", "FAILFAST").json(path, multiLine=True)
    if wrong := [r.schema_version for r in df.select("schema_version").limit(2).collect() if r.schema_version != BASELINE_VERSION]:
        raise ValueError(f"{path}: schema version {wrong[0]}, not {BASELINE_VERSION}")
    return df.select(F.inline("findings"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Run receipts of a ledger, one a line; lines that are no receipts are left out.

    Where the ledger is missing, its backup (the same name with .bak) is read.
    """
    if not os.path.exists(path.removeprefix("file://")) and os.path.exists(path.removeprefix("file://") + ".bak"):
        path += ".bak"
    raw = spark.read.schema(RECEIPT + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return raw.filter("broken IS NULL AND schema_version IS NOT NULL").drop("broken")


def feedback(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(rule_id, kind, path, reason, expires) of suppressions; an entry has a rule or a kind, not both."""
    ok = [e for e in entries if bool(e.get("rule_id")) != bool(e.get("kind")) and (not e.get("expires") or re.fullmatch(r"\d{4}-\d{2}-\d{2}", e["expires"]))]
    return spark.createDataFrame([tuple(e.get(k) for k in ("rule_id", "kind", "path", "reason", "expires")) for e in ok], "rule_id string, kind string, path string, reason string, expires string")
