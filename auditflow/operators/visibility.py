"""What findings are for, and which of them the default profile shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..functions.ranks import priority_rank, severity_rank


def _in(ids: tuple[str, ...]) -> Column:
    return F.col("rule_id").isin(*ids)


def intent() -> Column:
    """The purpose of a finding, from rule_id, category, severity and signal_source."""
    framework = F.col("category") == "FRAMEWORK"
    return (
        F.when(F.col("category") == "TESTING", "testing-gap")
        .when(F.col("category") == "SECURITY", "security-risk")
        .when(_in(rules.RUNTIME), "runtime-risk")
        .when(_in(rules.IMPORT_GRAPH), "actionable-risk")
        .when(framework & _in(rules.FRAMEWORK_STYLE), "maintainability")
        .when(framework & F.col("signal_source").isin(*rules.DIRECT_EVIDENCE), "actionable-risk")
        .when(_in(rules.MAINTAINABILITY), "maintainability")
        .when(severity_rank(F.col("severity")) >= 3, "actionable-risk")
        .otherwise("informational")
    )


def _verdict(visible: bool, reason: str, why: Column | str | None = None) -> Column:
    purpose = F.col("intent") if why is None else F.lit(why)
    return F.struct(purpose.alias("intent"), F.lit(visible).alias("visible"), F.lit(reason).alias("reason"))


def decision(script_boundary: Column | None = None) -> Column:
    """struct(intent, visible, reason), the first rule that applies.

    Needs the columns intent, rule_id, severity, confidence, priority, lifecycle, signal_source
    and has_evidence; script_boundary marks process exits in scripts and tooling.
    """
    sev, low = severity_rank(F.col("severity")), F.col("confidence") == "LOW"
    high, urgent = sev >= 3, priority_rank(F.col("priority")) <= 1
    direct = F.col("signal_source").isin(*rules.DIRECT_EVIDENCE)
    purpose = F.col("intent")
    script = F.lit(False) if script_boundary is None else script_boundary
    backed = direct & purpose.isin("security-risk", "runtime-risk", "actionable-risk")
    return (
        F.when(_in(rules.SECRET_LEAKS) & high & ~low, _verdict(True, "leaked-secret", "security-risk"))
        .when(low, _verdict(False, "low-confidence"))
        .when(sev <= 1, _verdict(False, "low-severity"))
        .when((F.col("rule_id") == rules.PACKAGE_BOUNDARY) & (F.col("confidence") == "HIGH") & (F.col("signal_source") == "import-graph") & F.col("has_evidence"), _verdict(True, "package-boundary", "actionable-risk"))
        .when(F.col("lifecycle") == "experimental", _verdict(False, "experimental-rule"))
        .when(F.col("lifecycle") == "deprecated", _verdict(False, "deprecated-rule"))
        .when((F.col("lifecycle") == "preview") & (F.col("confidence") == "MEDIUM") & ~backed, _verdict(False, "preview-without-evidence"))
        .when((purpose == "security-risk") & high, _verdict(True, "security"))
        .when(purpose == "security-risk", _verdict(False, "security-below-threshold"))
        .when((purpose == "runtime-risk") & script, _verdict(False, "exit-in-script"))
        .when((purpose == "runtime-risk") & urgent, _verdict(True, "runtime-urgent"))
        .when((purpose == "runtime-risk") & high, _verdict(True, "runtime-severe"))
        .when(purpose == "runtime-risk", _verdict(False, "runtime-below-threshold"))
        .when((purpose == "actionable-risk") & _in(rules.IMPORT_GRAPH) & (priority_rank(F.col("priority")) <= 2), _verdict(True, "import-graph"))
        .when((purpose == "actionable-risk") & backed, _verdict(True, "evidence-backed"))
        .when((purpose == "actionable-risk") & urgent, _verdict(True, "actionable-urgent"))
        .when((purpose == "actionable-risk") & high & (F.col("confidence") == "HIGH"), _verdict(True, "actionable-severe"))
        .when(purpose == "actionable-risk", _verdict(False, "actionable-below-threshold"))
        .when((purpose == "maintainability") & _in(rules.STRICT_ONLY), _verdict(False, "strict-only"))
        .when((purpose == "maintainability") & urgent, _verdict(True, "maintainability-urgent"))
        .when(purpose == "maintainability", _verdict(False, "maintainability-below-threshold"))
        .when(purpose == "testing-gap", _verdict(False, "testing-gap"))
        .otherwise(_verdict(False, "informational"))
    )


def classified(findings: DataFrame, script_boundary: Column | None = None) -> DataFrame:
    """findings with intent, visible and reason."""
    df = findings.withColumn("intent", intent()).withColumn("_v", decision(script_boundary))
    return df.withColumns({"intent": F.col("_v.intent"), "visible": F.col("_v.visible"), "reason": F.col("_v.reason")}).drop("_v")


def profile(classified_: DataFrame, strict: bool = False) -> DataFrame:
    return classified_ if strict else classified_.filter("visible")


def hidden_summary(classified_: DataFrame) -> DataFrame:
    """(intent, rule_id, category, reason, n) of what the default profile hides."""
    return classified_.filter("NOT visible").groupBy("intent", "rule_id", "category", "reason").agg(F.count(F.lit(1)).alias("n"))


def hidden_order() -> list[Column]:
    """The order of a hidden summary in reports: most first."""
    return [F.desc("n"), F.col("intent"), F.col("rule_id"), F.col("reason")]
