"""Configuration, overlays, knowledge packs, feedback and earlier reports, read from files."""

from __future__ import annotations

import datetime
import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

from ..functions.ranks import SEVERITIES

#: Schema versions of scan reports that are read.
REPORT_VERSIONS = ("0.16", "0.17", "0.18", "0.19", "0.20", "0.21", "0.22", "0.23", "0.24", "0.25")
DEFAULTS = {"max_files": None, "max_bytes": 2 * 1024 * 1024, "max_fan_out": 15, "large_file": 300, "long_function": 50, "complex_function": 15, "max_control_flow_depth": 4, "impact_path_depth": 3}

OVERLAY = "ord int, rule_id string, kind string, pattern string, severity string, expires string, reason string"
FEEDBACK = "entry int, rule_id string, kind string, path string, reason string, expires string"
KNOWLEDGE = "rule_id string, languages array<string>, minimum_support string, frameworks array<string>, runtimes array<string>, paradigms array<string>, suppress_low_signal boolean, suppress_config boolean, suppress_generated boolean"
OVERRIDES = "ord int, rule_id string, role string, severity string, reason string"


class Invalid(ValueError):
    """A file that cannot be used, and why."""


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _toml(path: str) -> dict:
    text = _text(path)
    try:
        return tomllib.loads(text) if text is not None else {}
    except tomllib.TOMLDecodeError as e:
        raise Invalid(f"{path}: {e}") from e


def settings(path: str) -> dict:
    """DEFAULTS with what a configuration file sets; unknown names are an error."""
    found = {k.replace("-", "_"): v for table in ({}, *(v for v in _toml(path).values() if isinstance(v, dict))) for k, v in table.items()}
    found |= {k: v for k, v in _toml(path).items() if not isinstance(v, dict)}
    known = {k: v for k, v in found.items() if k in DEFAULTS}
    if wrong := [k for k, v in known.items() if not isinstance(v, int) or isinstance(v, bool) or v < 0]:
        raise Invalid(f"{path}: {', '.join(sorted(wrong))} must be a count")
    return DEFAULTS | known


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ** crosses directories, * and ? do not."""
    parts = re.findall(r"\*\*/|\*\*|\*|\?|\[[^]]+\]|\{[^}]*\}|[^*?\[{]+|.", glob)
    turn = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    one = lambda p: turn.get(p) or (p if p[0] == "[" and len(p) > 1 else "(?:" + "|".join(map(re.escape, p[1:-1].split(","))) + ")" if p[0] == "{" and p[-1] == "}" else re.escape(p))
    return "^" + "".join(map(one, parts)) + "$"


def _date(value) -> str | None:
    if value is None:
        return None
    text = value.isoformat() if isinstance(value, datetime.date) else str(value)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"{text!r} is no YYYY-MM-DD date")
    return text


def overlay(spark: SparkSession, root: str, name: str = ".auditflow/overlay.toml", known_rules: tuple[str, ...] = ()) -> DataFrame:
    """Entries that change or silence rules or review kinds for paths, in order; bad entries are an error."""
    path, rows = os.path.join(root, name), []
    for i, e in enumerate(_toml(path).get("entry", []), 1):
        try:
            if bool(e.get("rule")) == bool(e.get("kind")):
                raise ValueError("needs a rule or a kind, not both")
            if known_rules and e.get("rule") and e["rule"] not in known_rules:
                raise ValueError(f"no rule {e['rule']}")
            severity = e.get("severity", "suppress").upper()
            if severity not in (*SEVERITIES, "SUPPRESS"):
                raise ValueError(f"no severity {severity}")
            rows.append((i, e.get("rule"), e.get("kind"), glob_pattern(e["path"]) if e.get("path") else None, None if severity == "SUPPRESS" else severity, _date(e.get("expires")), e.get("reason")))
        except ValueError as err:
            raise Invalid(f"{path}: entry {i}: {err}") from err
    return spark.createDataFrame(rows, OVERLAY)


def knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(gates of rules, their ordered overrides) of a knowledge pack."""
    gates, overrides = [], []
    for r in _toml(path).get("rule", []):
        s = r.get("suppress", {})
        gates.append((r["id"], r.get("languages", []), r.get("minimum_support"), r.get("frameworks", []), r.get("runtimes", []), r.get("paradigms", []), bool(s.get("low_signal")), bool(s.get("config")), bool(s.get("generated"))))
        overrides += [(i, r["id"], o.get("role"), o.get("severity", "").upper() or None, o.get("reason")) for i, o in enumerate(r.get("override", []))]
    return spark.createDataFrame(gates, KNOWLEDGE), spark.createDataFrame(overrides, OVERRIDES)


def feedback_entries(text: str) -> list[dict]:
    """The entries of a feedback file: a list of flat mappings under `suppressions:`."""
    out: list[dict] = []
    for n, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() in ("---", "suppressions:", "suppressions: []") or re.fullmatch(r"version:\s*\d+", bare):
            continue
        m = re.fullmatch(r"\s*(-\s+)?([A-Za-z_]\w*)\s*:\s*(.*)", bare)
        if not m or (not m[1] and not out):
            raise Invalid(f"line {n}: {line.strip()!r} is no entry")
        if m[1]:
            out.append({})
        value = m[3].strip()
        out[-1][m[2]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def feedback(spark: SparkSession, root: str, name: str = ".auditflow/feedback.yml") -> tuple[DataFrame, DataFrame]:
    """(entries, problems): suppressions that hold, and (entry, problem) for each that does not."""
    ok, bad = [], []
    for i, e in enumerate(feedback_entries(_text(os.path.join(root, name)) or ""), 1):
        rule, kind, path = e.get("rule_id") or e.get("rule"), e.get("kind"), e.get("path")
        problems = []
        if bool(rule) == bool(kind):
            problems.append("needs a rule or a kind, not both")
        if not path:
            problems.append("needs a path")
        if unknown := set(e) - {"rule_id", "rule", "kind", "path", "reason", "expires"}:
            problems.append(f"unknown: {', '.join(sorted(unknown))}")
        try:
            expires = _date(e.get("expires"))
        except ValueError as err:
            problems.append(str(err))
        if problems:
            bad += [(i, p) for p in problems]
        else:
            ok.append((i, rule, kind, path, e.get("reason"), expires))
    return spark.createDataFrame(ok, FEEDBACK), spark.createDataFrame(bad, "entry int, problem string")


def report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a scan report (rule_id, path, line_start, severity, title); other versions are an error."""
    text = _text(path)
    if text is None:
        raise Invalid(f"{path}: no such file")
    try:
        data = json.loads(text)
    except ValueError as e:
        raise Invalid(f"{path}: {e}") from e
    version = str(data.get("schema_version")) if isinstance(data, dict) else None
    if version not in REPORT_VERSIONS:
        raise Invalid(f"{path}: schema version {version} is not one of {', '.join(REPORT_VERSIONS)}")
    rows = []
    for f in data.get("findings", []):
        at = (f.get("evidence") or [{}])[0]
        rows.append((f.get("rule_id"), at.get("path"), at.get("line_start"), (f.get("severity") or "").upper(), f.get("title")))
    return spark.createDataFrame(rows, "rule_id string, path string, line_start int, severity string, title string")
