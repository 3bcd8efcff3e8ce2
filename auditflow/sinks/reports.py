"""Renderers over findings in canonical order.

A report made here is a document on the driver, so its rows are bounded by `limit`, and it says how
many more there are (`truncated`).  document.save() writes all rows, by tasks; write() exports them
as files in no order.
"""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import stable_key
from ..operators.findings import canonical_order

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Report levels by severity.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
LIMIT = 10_000


def keyed(findings: DataFrame) -> DataFrame:
    """findings with stable_key, by what they have of title, description and snippet."""
    col = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string")
    return findings if "stable_key" in findings.columns else findings.withColumn("stable_key", stable_key(F.col("rule_id"), F.col("path"), F.coalesce(col("title"), F.lit("")), F.coalesce(col("description"), F.lit("")), col("snippet")))


def ordered(findings: DataFrame, limit: int = LIMIT) -> tuple[list[dict], int]:
    """The first `limit` rows, and how many come after them."""
    rows = [r.asDict(recursive=True) for r in findings.orderBy(*canonical_order()).limit(limit + 1).collect()]
    return rows[:limit], findings.count() - limit if len(rows) > limit else 0


def to_json(findings: DataFrame, summary: DataFrame | None = None, limit: int = LIMIT) -> str:
    head = summary.first().asDict(recursive=True) if summary is not None else {}
    rows, more = ordered(findings, limit)
    return json.dumps({"schema_version": 1, "summary": head, "findings": rows, "truncated": more}, indent=2, default=str)


def sarif_result(r: dict) -> dict:
    place = {"artifactLocation": {"uri": r["path"]}} | ({"region": {"startLine": r["line_start"]}} if r.get("line_start") else {})
    return {
        "ruleId": r["rule_id"], "level": LEVELS[r["severity"]], "message": {"text": r.get("title") or r["rule_id"]}, "locations": [{"physicalLocation": place}],
        "partialFingerprints": {"stableKey/v1": r["stable_key"]}, "properties": {"score": r.get("score"), "priority": r.get("priority")},
    }


def markdown_row(r: dict) -> str:
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return "| " + " | ".join(map(cell, (r.get("priority"), r.get("score"), r["severity"], r["rule_id"], f"{r['path']}:{r['line_start']}"))) + " |"


def console_row(r: dict) -> str:
    return f"{r.get('priority')} {r['severity']:<8} {r['rule_id']} {r['path']}:{r['line_start']}"


def html_row(r: dict) -> str:
    cell = lambda v: f"<td>{html.escape(str(v))}</td>"
    return "<tr>" + "".join(map(cell, (r.get("priority"), r.get("score"), r["severity"], r["rule_id"], f"{r['path']}:{r['line_start']}", r.get("title", "")))) + "</tr>"


MARKDOWN_HEAD = ("| Priority | Score | Severity | Rule | Place |", "| --- | ---: | --- | --- | --- |")
HTML_HEAD = "<thead><tr>" + "".join(f"<th>{h}</th>" for h in ("Priority", "Score", "Severity", "Rule", "Place", "Title")) + "</tr></thead>"


def to_sarif(findings: DataFrame, limit: int = LIMIT) -> str:
    rows, more = ordered(keyed(findings), limit)
    rules = {}
    for r in rows:
        rules.setdefault(r["rule_id"], r)
    results = [sarif_result(r) for r in rows]
    driver = {"name": "auditflow", "rules": [{"id": k, "name": k, "shortDescription": {"text": v.get("title") or k}} for k, v in sorted(rules.items())]}
    return json.dumps({"$schema": SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results, "properties": {"truncated": more}}]}, indent=2)


def to_markdown(findings: DataFrame, title: str = "Audit", limit: int = 50) -> str:
    rows, more = ordered(findings, limit)
    lines = [f"# {title}", "", *MARKDOWN_HEAD, *map(markdown_row, rows), *(["", f"{more} more findings are left out."] if more else [])]
    return "\n".join(lines) + "\n"


def write(findings: DataFrame, path: str, fmt: str = "json") -> None:
    """All findings as files, in no particular order."""
    findings.write.mode("overwrite").format(fmt).save(path)


def baseline(findings: DataFrame) -> DataFrame:
    """(key, rule_id, severity, path, message) sorted by key, once a key."""
    row = F.struct("severity", "title")
    return findings.groupBy("key", "rule_id", "path").agg(F.min(row).alias("r")).select("key", "rule_id", F.col("r.severity").alias("severity"), "path", F.col("r.title").alias("message")).orderBy("key")


def within_budget(findings: DataFrame, cost: str, budget: int) -> DataFrame:
    """The findings of each category, best first, whose summed cost fits its share of a budget.

    A category's share goes by its number of findings.
    """
    from pyspark.sql.window import Window

    n = findings.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    share = n.crossJoin(F.broadcast(total)).select("category", F.floor(F.lit(budget) * F.col("_n") / F.col("_t")).alias("_share"))  # one row
    # sums by score find the score at which a category's share runs out; only its findings are ordered
    by_score = findings.groupBy("category", "score").agg(F.sum(cost).alias("_c"))
    upto = Window.partitionBy("category").orderBy(F.desc("score"))  # at most 101 scores a category
    sums = by_score.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).join(F.broadcast(share), "category")  # five categories
    open_ = sums.filter("_before < _share").select(F.col("category").alias("_k"), F.col("score").alias("_s"), "_before", "_share", (F.col("_before") + F.col("_c") <= F.col("_share")).alias("_all"))
    near = findings.join(F.broadcast(open_), (F.col("category") == F.col("_k")) & (F.col("score") == F.col("_s")))  # 5 x 101 rows
    w = Window.partitionBy("category", "score").orderBy(*canonical_order(), "finding_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = near.filter("NOT _all").withColumn("_used", F.col("_before") + F.sum(cost).over(w)).filter("_used <= _share")
    return near.filter("_all").select(*findings.columns).unionByName(some.select(*findings.columns))


#: The formats of reports, by name.
FORMATS = ("console", "html", "json", "markdown", "sarif")


def to_console(findings: DataFrame, limit: int = 50) -> str:
    rows, more = ordered(findings, limit)
    return "".join(f"{x}\n" for x in [*map(console_row, rows), *([f"and {more} more"] if more else [])]) or "no findings\n"


def to_html(findings: DataFrame, title: str = "Audit", limit: int = 500) -> str:
    rows, more = ordered(findings, limit)
    body = "".join(html_row(r) + "\n" for r in rows)
    note = f"<p>{more} more findings are left out.</p>" if more else ""
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body><h1>{html.escape(title)}</h1>\n<table>{HTML_HEAD}\n<tbody>\n{body}</tbody></table>{note}</body></html>\n'


def render(findings: DataFrame, fmt: str, **options) -> str:
    """A report in one of FORMATS."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is not one of {', '.join(FORMATS)}")
    return {"console": to_console, "html": to_html, "json": to_json, "markdown": to_markdown, "sarif": to_sarif}[fmt](findings, **options)


def receipt(findings: DataFrame, files: DataFrame, hidden: DataFrame, git: dict | None = None) -> dict:
    """What an audit looked at and found: counts of files by reason and language, of findings by severity, and of what is hidden."""
    from ..operators import metrics

    scope = metrics.scan_counters(files).first().asDict()
    severities = metrics.severity_counts(findings).first().asDict()
    languages = {r.language: r.files for r in metrics.language_summary(files).collect()}  # one row a language
    reasons = [r.asDict() for r in hidden.limit(LIMIT).collect()]
    return {"schema_version": 1, "tool": "auditflow", "git": git or {}, "scope": scope, "findings": severities | {"total": sum(severities.values())}, "hidden": reasons, "languages": languages}


def snapshot_marker(path: str, revision: str, fingerprint: str, n_findings: int) -> dict:
    """Write down that a state was audited; the file is replaced as a whole."""
    marker = {"schema_version": 1, "revision": revision, "fingerprint": fingerprint, "findings": n_findings}
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(marker, f, indent=2)
    os.replace(part, path)
    return marker
