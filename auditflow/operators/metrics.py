"""Summaries of files and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import cluster_scope, parent
from ..functions.ranks import PRIORITIES, label, priority_rank

#: Penalty points by severity.
PENALTY = {"CRITICAL": 20.0, "HIGH": 5.0, "MEDIUM": 2.0, "LOW": 0.5, "INFO": 0.0}


def language_summary(files: DataFrame) -> DataFrame:
    return files.filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def scan_counters(files: DataFrame) -> DataFrame:
    """One row: files seen, analysed, skipped by reason, and lines of the analysed."""
    skipped = lambda r: F.count_if(F.col("skip_reason") == r)
    return files.agg(
        F.count(F.lit(1)).alias("files_discovered"), F.count_if(F.col("skip_reason").isNull()).alias("files_analyzed"),
        skipped("large-file").alias("large_files_skipped"), skipped("binary").alias("binary_files_skipped"), skipped("low-signal").alias("low_signal_skipped"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("non_empty_lines"))), F.lit(0)).alias("non_empty_lines"),
    )


def health(penalty: Column, lines: Column) -> Column:
    """100 less the penalty per thousand lines, cut to 0..100 and truncated."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.coalesce(penalty, F.lit(0.0)) / F.greatest(lines / 1000.0, F.lit(0.5))))).cast("int")


def penalty() -> Column:
    out = F.lit(0.0)
    for name, points in PENALTY.items():
        out = F.when(F.col("severity") == name, points).otherwise(out)
    return out


def health_score(findings: DataFrame, lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., findings, health_score); lines: (by..., non_empty_lines)."""
    by = by or []
    p = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.sum(penalty()).alias("_p"))
    joined = lines.join(p, by, "left") if by else lines.crossJoin(p)  # without keys both are one row
    return joined.select(*by, F.coalesce("findings", F.lit(0)).alias("findings"), health(F.col("_p"), F.col("non_empty_lines")).alias("health_score"))


def risk_summary(findings: DataFrame) -> DataFrame:
    """One row: total, counts by priority, best priority, rounded mean score."""
    n = [F.count_if(F.col("priority") == p).alias(p.lower()) for p in PRIORITIES]
    return findings.agg(F.count(F.lit(1)).alias("total"), *n, label(F.min(priority_rank(F.col("priority"))), PRIORITIES).alias("highest_priority"), F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(0)).cast("int").alias("average_score"))


def percent(part: Column, total: Column) -> Column:
    """Whole percent, halves up, 100 of nothing."""
    return F.when(total == 0, 100).otherwise(F.floor((part * 100 + F.floor(total / 2)) / total)).cast("int")


def signal_quality(findings: DataFrame) -> DataFrame:
    """One row: counts by confidence, lifecycle and source, and three coverages."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    total, high = F.count(F.lit(1)), F.count_if(F.col("severity").isin("HIGH", "CRITICAL"))
    docs = F.trim(F.coalesce("docs_url", F.lit(""))) != ""
    return findings.agg(
        total.alias("total"), *(n("confidence", c).alias(f"confidence_{c.lower()}") for c in ("LOW", "MEDIUM", "HIGH")),
        *(n("lifecycle", c).alias(f"lifecycle_{c}") for c in ("experimental", "preview", "stable", "deprecated")),
        *(n("signal_source", c).alias("source_" + c.replace("-", "_")) for c in ("text-heuristic", "ast", "config-file", "dependency-manifest", "import-graph", "framework-detector", "git-diff", "mixed")),
        percent(F.count_if(F.col("path").isNotNull()), total).alias("evidence_percent"), percent(F.count_if(F.trim("recommendation") != ""), total).alias("recommendation_percent"),
        percent(F.count_if(F.col("severity").isin("HIGH", "CRITICAL") & docs), high).alias("high_risk_docs_percent"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")))


def risky_clusters(findings: DataFrame, limit: int = 20) -> DataFrame:
    """Rule and area by findings, highest score and best priority; the top ones."""
    g = findings.groupBy("rule_id", cluster_scope(F.col("path")).alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), label(F.min(priority_rank(F.col("priority"))), PRIORITIES).alias("best_priority"))
    return g.orderBy(F.desc("max_score"), F.desc("n"), "rule_id", "scope").limit(limit)


def package_counts(findings: DataFrame) -> DataFrame:
    return findings.filter("package IS NOT NULL").groupBy("package").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")))


def crowded_directories(files: DataFrame, most: int = 20) -> DataFrame:
    """(directory, files) of directories with more than `most` files."""
    return files.groupBy(parent(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > most)


def maintainability_score(classified: DataFrame, lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The health score over what the default profile hides; classified: severity and visible."""
    return health_score(classified.filter("NOT visible"), lines, by).withColumnRenamed("health_score", "maintainability_score")


def recomputed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: what a report's figures are after a filter."""
    quality = signal_quality(findings).select(F.col("total").alias("visible"), "evidence_percent", "recommendation_percent", "high_risk_docs_percent")
    return quality.crossJoin(health_score(findings, lines).select("health_score"))  # one row each


def repository_facts(files: DataFrame) -> DataFrame:
    """(language, files, non_empty_lines, total_files, files_with_language) by language, most files first."""
    n = files.agg(F.count(F.lit(1)).alias("total_files"), F.count("language").alias("files_with_language"))
    by = files.filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("non_empty_lines").alias("non_empty_lines"))
    return by.crossJoin(n).orderBy(F.desc("files"), F.desc("non_empty_lines"), "language")  # n is one row


def merged_packages(summaries: list[DataFrame]) -> DataFrame:
    """One row: counters of several packages' scans (as scan_counters gives them) added up."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.agg(*(F.sum(c).alias(c) for c in summaries[0].columns))


def rule_scopes(findings: DataFrame) -> DataFrame:
    """(rule_id, scope, n, worst): findings by rule and area."""
    from ..functions.ranks import SEVERITIES, severity_rank

    return findings.groupBy("rule_id", cluster_scope(F.col("path")).alias("scope")).agg(F.count(F.lit(1)).alias("n"), label(F.max(severity_rank(F.col("severity"))), SEVERITIES).alias("worst"))
