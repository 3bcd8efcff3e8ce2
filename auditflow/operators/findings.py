"""Filters, enrichment, dedup, contracts and suppression of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.ranks import CATEGORIES, CONFIDENCES, PRIORITIES, SEVERITIES, category_rank, confidence_rank, label, priority_rank, severity_rank


def matching(findings: DataFrame, severity=None, confidence=None, priority=None, rule_ids=None) -> DataFrame:
    """Findings at or above every given label, of the given rules; what is not given passes."""
    keep = F.lit(True)
    if severity:
        keep = keep & (severity_rank(F.col("severity")) >= SEVERITIES.index(severity))
    if confidence:
        keep = keep & (confidence_rank(F.col("confidence")) >= CONFIDENCES.index(confidence))
    if priority:
        keep = keep & (priority_rank(F.col("priority")) <= PRIORITIES.index(priority))
    if rule_ids:
        keep = keep & F.col("rule_id").isin(*rule_ids)
    return findings.filter(keep)


def without_rules(findings: DataFrame, disabled: list[str]) -> DataFrame:
    return findings.filter(~F.col("rule_id").isin(*disabled)) if disabled else findings


def with_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: (rule_id, severity); findings that an overlay decided keep their severity."""
    o = overrides.select(F.col("rule_id").alias("_rule"), F.col("severity").alias("_severity"))
    df = findings.join(o, F.col("rule_id") == F.col("_rule"), "left")
    decided = F.coalesce(F.col("overlay_applied"), F.lit(False)) if "overlay_applied" in findings.columns else F.lit(False)
    return df.withColumn("severity", F.when(decided, F.col("severity")).otherwise(F.coalesce("_severity", "severity"))).drop("_rule", "_severity")


def enriched(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill from the registry: category, lifecycle, source; severity and confidence by its rules.

    INFO without a decision and MEDIUM confidence stand for "not set".  Severity never rises over
    the rule's ceiling; confidence is the rule's unless the rule lets its context set it.
    """
    r = registry.select(*(F.col(c).alias(f"_{c}") for c in registry.columns))
    df = findings.join(F.broadcast(r), F.col("rule_id") == F.col("_rule_id"), "left")  # one row a rule
    known = F.col("_rule_id").isNotNull()
    decided = F.coalesce(F.col("decided"), F.lit(False)) if "decided" in findings.columns else F.lit(False)
    sev, top = severity_rank(F.col("severity")), F.greatest(severity_rank(F.col("_max_severity")), severity_rank(F.col("_default_severity")))
    severity = F.when(~known, F.col("severity")).when((sev == 0) & ~decided, F.col("_default_severity")).otherwise(label(F.least(sev, top), SEVERITIES))
    conf, most = confidence_rank(F.col("confidence")), F.greatest(confidence_rank(F.col("_max_confidence")), confidence_rank(F.col("_default_confidence")))
    confidence = F.when(~known, F.col("confidence")).when(~F.col("_contextual_confidence") | (conf == 1), F.col("_default_confidence")).otherwise(label(F.least(conf, most), CONFIDENCES))
    added = {"severity": severity, "confidence": confidence}
    for c in ("category", "lifecycle", "signal_source"):
        added[c] = F.coalesce(F.col(c), F.col(f"_{c}")) if c in findings.columns else F.col(f"_{c}")
    return df.withColumns(added).drop(*r.columns)


def canonical_order(*before: Column) -> list[Column]:
    """Sort keys of reports: score, severity, category, rule, then place as a string."""
    return [*before, F.desc("score"), severity_rank(F.col("severity")).desc(), F.coalesce(category_rank(F.col("category")), F.lit(len(CATEGORIES))), F.col("rule_id"), F.concat_ws(":", "path", "line_start")]


AGGREGATION_KEY = ("rule_id", "path", "line_start", "line_end", "snippet", "category", "title", "description", "package", "detector")


def aggregated(findings: DataFrame, order: str = "finding_no") -> DataFrame:
    """Exact duplicates as one: highest labels, first recommendation and link in order, evidence united.

    findings: AGGREGATION_KEY, severity, confidence, recommendation, docs_url, evidence (array).
    """
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(order)))
    out = findings.groupBy(*AGGREGATION_KEY).agg(
        F.min(order).alias(order), label(F.max(severity_rank(F.col("severity"))), SEVERITIES).alias("severity"), label(F.max(confidence_rank(F.col("confidence"))), CONFIDENCES).alias("confidence"),
        F.coalesce(first("recommendation", F.trim("recommendation") != ""), F.lit("")).alias("recommendation"), first("docs_url", F.col("docs_url").isNotNull()).alias("docs_url"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("evidence").alias("e")))), lambda x: x["e"]))).alias("evidence"), F.count(F.lit(1)).alias("merged"),
    )
    return out


def first_per_place(findings: DataFrame, order: str = "finding_no") -> DataFrame:
    """Of findings with the same rule, path and line, the first in order.

    min_by combines before the shuffle, so a very common place is one row a task.
    """
    row = F.struct(*findings.columns)
    return findings.groupBy("rule_id", "path", "line_start").agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def violations(findings: DataFrame) -> DataFrame:
    """(finding_no, violation): contracts that a finding breaks."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    high = severity_rank(F.col("severity")) >= 3
    checks = [("empty-id", blank("id")), ("empty-rule-id", blank("rule_id")), ("empty-title", blank("title")), ("empty-description", blank("description")), ("empty-recommendation", blank("recommendation")), ("missing-evidence", F.size("evidence") == 0)]
    each = F.flatten(F.transform("evidence", lambda e: F.array(F.when(F.coalesce(e["path"], F.lit("")) == "", F.lit("invalid-evidence-path")), F.when((e["line_start"] == 0) | (F.coalesce(e["line_end"], e["line_start"]) < e["line_start"]), F.lit("invalid-evidence-line-range")))))
    rest = [("missing-risk-formula-version", blank("formula_version")), ("missing-risk-signals", F.size("signals") == 0), ("missing-docs-for-high-severity", high & blank("docs_url"))]
    listed = lambda pairs: F.array(*(F.when(ok, F.lit(name)) for name, ok in pairs))
    return findings.select("finding_no", F.explode(F.array_compact(F.concat(listed(checks), each, listed(rest)))).alias("violation"))


def suppressed(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Findings without those that feedback (rule_id, path) names."""
    return findings.join(feedback.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_anti")


def unmatched(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """Feedback entries that no finding matches."""
    return feedback.join(findings.select("rule_id", "path").distinct(), ["rule_id", "path"], "left_anti")


def with_files(findings: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """findings beside their file's columns, by path as given or relative to root."""
    from ..functions.paths import relative

    f = files.select(relative(F.col("path"), root).alias("_path"), *(F.col(c).alias(f"file_{c}") for c in files.columns if c != "path"))
    return findings.join(f, relative(F.col("path"), root) == F.col("_path"), "left").drop("_path")


def page(findings: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the canonical order."""
    return findings.orderBy(*canonical_order(), "finding_no").offset(offset).limit(limit)


def numbered(df: DataFrame, by: list[str], order: list, name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def union(streams: list[DataFrame]) -> DataFrame:
    """Findings of several rules as one relation; what a stream lacks is null."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def with_status_order(findings: DataFrame, status: DataFrame, key: str = "finding_no") -> DataFrame:
    """findings beside their status (key, ...), in the canonical order of findings."""
    return findings.join(status, key, "left").orderBy(*canonical_order(), key)
