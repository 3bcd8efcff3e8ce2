"""Review reports: signals of all families in tiers, suppressed, ranked and summed up.

Signals are rows (family, kind, path, line, headline, detail, coarse); a report is a set of
relations, and its verdict one row of counted reasons.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import review, risk
from .findings import canonical_order

COLUMNS = ("family", "kind", "path", "line", "headline", "detail", "coarse")

#: Reasons that block, the others, in the order of reports.
BLOCKING = ("analysis-error", "finding-gate-failed", "review-signal-gate-failed", "priority-p0", "verification-failed", "verification-timed-out", "verification-unavailable", "verification-cancelled", "verification-revision-changed")
REASONS = ("analysis-error", "finding-gate-failed", "review-signal-gate-failed", "priority-p0", "priority-p1", "definitely-sensitive", "maybe-sensitive", "boundary-missing-test", "visible-finding", "unowned-surface", "verification-failed", "verification-timed-out", "verification-unavailable", "verification-cancelled", "verification-revision-changed")

_SURE = (*review.DEFINITE, "removed-export-still-imported")


def signals_of(df: DataFrame, family: str, kind="kind", path="path", line: str | None = "line", detail: str | None = None, coarse: Column | None = None) -> DataFrame:
    """Any relation with a kind and a path as signals of a family."""
    text = F.regexp_replace(F.col(kind), "-", " ")
    return df.select(
        F.lit(family).alias("family"), F.col(kind).alias("kind"), F.col(path).alias("path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"),
        (F.concat(text, F.lit(" changed")) if family == "boundary" else text).alias("headline"), (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"), (F.lit(False) if coarse is None else coarse).alias("coarse"),
    )


def tiered(signals: DataFrame, ranges: DataFrame) -> DataFrame:
    """signals with tier and gate_eligible, equal ones merged, and one for the sheer size of a diff without others.

    Boundary signals are sure; a network call inside access control counts more than elsewhere.
    """
    code = signals.filter((F.col("family") == "boundary") & F.col("kind").isin("access-control", "request-trust")).select(F.col("path").alias("_access")).distinct()
    df = signals.join(code, F.col("path") == F.col("_access"), "left")
    sure = F.col("kind").isin(*_SURE) | (F.col("family") == "boundary") | ((F.col("kind") == "network-call-added") & F.col("_access").isNotNull())
    df = df.withColumn("tier", F.when(F.col("coarse"), "noise").when(sure, "definitely").otherwise("maybe")).drop("_access")
    merged = df.groupBy("family", "kind", "path", "tier").agg(
        F.array_sort(F.array_compact(F.collect_set("line"))).alias("lines"), F.min("line").alias("line"), F.max("line").alias("last_line"), F.min("headline").alias("headline"), F.min_by("detail", F.struct(F.col("line"), F.col("detail"))).alias("detail"),
    )
    any_ = merged.agg(F.coalesce(F.bool_or(F.col("tier") != "noise"), F.lit(False)).alias("_any"))
    size = review.diff_size(ranges).crossJoin(any_).filter("large AND NOT _any")  # one row each
    volume = size.select(
        F.lit("volume").alias("family"), F.lit("large-diff").alias("kind"), F.lit("").alias("path"), F.lit("noise").alias("tier"), F.array().cast("array<int>").alias("lines"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("last_line"),
        F.lit("a large diff without other signals").alias("headline"), F.concat_ws(" ", "files", F.lit("files,"), "lines", F.lit("changed lines")).alias("detail"),
    )
    out = merged.unionByName(volume)
    return out.withColumn("gate_eligible", (F.col("tier") == "definitely") & (F.col("family") != "volume"))


def suppressed(signals: DataFrame, overlay: DataFrame, feedback: DataFrame, today: Column) -> DataFrame:
    """signals with suppressed and reason: by the overlay first, then by feedback, both by kind and path.

    overlay, feedback: (kind, pattern, expires, reason); a null pattern is any path.  A suppressed
    signal is no longer eligible for the gate.
    """

    def hits(entries, name):
        e = entries.select(F.col("kind").alias("_kind"), "pattern", F.col("expires").alias("_until"), F.col("reason").alias("_reason")).filter(~review.expired(F.col("_until"), today))
        j = signals.select("kind", "path").distinct().join(e, (F.col("kind") == F.col("_kind")) & (F.col("pattern").isNull() | F.expr("path RLIKE pattern")))
        return j.groupBy("kind", "path").agg(F.min(F.coalesce("_reason", F.lit(""))).alias(name))

    df = signals.join(hits(overlay, "_o"), ["kind", "path"], "left").join(hits(feedback, "_f"), ["kind", "path"], "left")
    gone = F.col("_o").isNotNull() | F.col("_f").isNotNull()
    return df.withColumns({"suppressed": gone, "reason": F.coalesce("_o", "_f"), "gate_eligible": F.col("gate_eligible") & ~gone}).drop("_o", "_f")


def in_diff(findings: DataFrame, changed: DataFrame, ranges: DataFrame, key: str = "finding_no") -> DataFrame:
    """(key): findings with any evidence on a changed line, or architecture findings about a changed file.

    findings: key, category, evidence (structs path, line_start, line_end).
    """
    each = findings.select(key, "category", F.explode("evidence").alias("e")).select(key, "category", "e.path", "e.line_start", "e.line_end")
    lines = each.join(ranges.select(F.col("path").alias("_p"), "start", "stop"), (F.col("path") == F.col("_p")) & F.col("line_start").between(F.col("start"), F.col("stop")), "left_semi")
    whole = each.filter((F.col("category") == "ARCHITECTURE") & (F.col("line_start") == 1) & F.col("line_end").isNull()).join(changed.select("path").distinct(), "path", "left_semi")
    return lines.select(key).unionByName(whole.select(key)).distinct()


@dataclass
class Report:
    """The relations of one review."""

    findings: DataFrame  # with in_diff, score and priority, overlays applied
    signals: DataFrame  # tiered, with importers and suppressed
    impact: DataFrame  # (seed, node, hop)
    owners: DataFrame  # (path, owners) of changed and impacted paths
    missing_test: DataFrame  # one row


def assembled(findings: DataFrame, changed: DataFrame, ranges: DataFrame, signals: DataFrame, edges: DataFrame, owner_rules: DataFrame, overlay: DataFrame, feedback: DataFrame, today: Column, depth: int = 3) -> Report:
    """A review of scored findings (finding_no, evidence, path, ...) and signals of a change."""
    from . import behavior, graph

    files = changed.select(F.col("path").alias("node")).distinct()
    impact = graph.impact(edges, files, depth)
    f = findings.join(in_diff(findings, changed, ranges).withColumn("in_diff", F.lit(True)), "finding_no", "left").withColumn("in_diff", F.coalesce("in_diff", F.lit(False)))
    f = risk.blast_overlay(risk.review_overlay(f), graph.one_hop_radius(edges, files).select(F.col("node").alias("path")))
    s = suppressed(tiered(signals, ranges), overlay, feedback, today)
    s = review.importer_counts(s, edges)
    paths = changed.select("path").unionByName(impact.select(F.col("node").alias("path"))).distinct()
    boundaries = signals.filter("family = 'boundary'").select(F.col("kind").alias("boundary"))
    return Report(f, s, impact, review.owners(paths, owner_rules), behavior.missing_test(boundaries, changed))


def reasons(report: Report, errors: int = 0, failed_findings: DataFrame | None = None, failed_signals: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """(code, n, blocking) of everything that keeps a change from being ready, in the order of REASONS.

    failed_*: one-row gates (failed).  checks: (status, revision_compatible) of selected verifications.
    """
    count = lambda df, code, when: df.agg(F.count_if(when).alias("n")).select(F.lit(code).alias("code"), "n")
    inside, live = F.col("in_diff"), ~F.col("suppressed")
    spark = report.findings.sparkSession
    parts = [
        spark.createDataFrame([("analysis-error", errors)], "code string, n long"),
        count(report.findings, "priority-p0", inside & (F.col("priority") == "P0")), count(report.findings, "priority-p1", inside & (F.col("priority") == "P1")), count(report.findings, "visible-finding", inside),
        count(report.signals, "definitely-sensitive", live & (F.col("tier") == "definitely")), count(report.signals, "maybe-sensitive", live & (F.col("tier") == "maybe")),
        count(report.missing_test, "boundary-missing-test", F.col("missing")), count(report.owners, "unowned-surface", F.col("owners").isNull() | (F.size("owners") == 0)),
    ]
    if failed_findings is not None:
        parts.append(failed_findings.select(F.lit("finding-gate-failed").alias("code"), F.col("failed").alias("n")))
    if failed_signals is not None:
        parts.append(failed_signals.select(F.lit("review-signal-gate-failed").alias("code"), F.col("failed").alias("n")))
    if checks is not None:
        parts += [count(checks, f"verification-{s}", F.col("status") == s) for s in ("failed", "timed-out", "unavailable", "cancelled")]
        parts.append(count(checks, "verification-revision-changed", ~F.col("revision_compatible")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("code"))
    return out.filter("n > 0").withColumn("blocking", F.col("code").isin(*BLOCKING)).orderBy(rank)


def verdict(reasons_: DataFrame) -> DataFrame:
    """One row: ready without reasons, blocked by a blocking one, else review."""
    return reasons_.agg(F.count(F.lit(1)).alias("reasons"), F.count_if("blocking").alias("blocking")).withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").when(F.col("reasons") > 0, "review").otherwise("ready"))


def signal_gate(signals: DataFrame) -> DataFrame:
    """One row (failed, passed): sure signals that nothing suppresses."""
    return signals.agg(F.count_if(F.col("gate_eligible") & ~F.col("suppressed")).alias("failed")).select("failed", (F.col("failed") == 0).alias("passed"))


def rendered(report: Report, reasons_: DataFrame, fmt: str = "markdown", limit: int = 200) -> str:
    """The report as markdown, console text, JSON or SARIF; lists are cut at `limit` rows each, and the report says by how many."""
    from ..sinks import reports

    v = verdict(reasons_).first()
    why = [r.asDict() for r in reasons_.limit(limit).collect()]
    inside = report.findings.filter("in_diff")
    rank = F.array_position(F.array(*map(F.lit, ("definitely", "maybe", "noise"))), F.col("tier"))
    if fmt == "sarif":
        return reports.to_sarif(inside, limit)
    signals = [r.asDict() for r in report.signals.orderBy(rank, *review.tier_order(id_="kind")).limit(limit + 1).collect()]
    hidden = report.signals.count() - limit if len(signals) > limit else 0
    signals = signals[:limit]
    rows, more = reports.ordered(inside, limit)
    if fmt == "json":
        return json.dumps({"schema_version": 1, "verdict": v.verdict, "reasons": why, "findings": rows, "signals": signals, "truncated": {"findings": more, "signals": hidden}}, indent=2, default=str)
    head, item = ("# Review", "- ") if fmt == "markdown" else ("Review", "  ")
    out = [head, "", f"Verdict: {v.verdict}", "", *(f"{item}{r['code']}: {r['n']}" for r in why), ""]
    for tier in ("definitely", "maybe", "noise"):
        mine = [s for s in signals if s["tier"] == tier and not s["suppressed"]]
        if mine:
            out += [f"## {tier}" if fmt == "markdown" else tier.upper(), ""]
            out += [f"{item}{s['path'] or '(whole diff)'}{':' + str(s['line']) if s['line'] else ''} {s['headline']} (importers: {s['importers']})" for s in mine]
            out.append("")
    out += [f"{item}{r['priority']} {r['rule_id']} {r['path']}:{r['line_start']}" for r in rows]
    if more or hidden:
        out += ["", f"Left out: {more} findings, {hidden} signals"]
    return "\n".join(out).rstrip() + "\n"
